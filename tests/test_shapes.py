import random
import struct
import zipfile

import pytest

from fieldroute.operators.polygons import area, boundary
from fieldroute.sources import shapes as S


def write(folder, records, name="zones", gap=()):
    """Shape, index and attribute file of (code, place, rings or None, deleted) records; ``gap`` numbers get unused bytes before them."""
    shp, shx, at = [], [], 100
    for k, (_, _, rings, _) in enumerate(records):
        if rings is None:
            body = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            xs, ys = zip(*points)
            starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
            body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        if k in gap:
            shp.append(b"\0" * 6)
            at += 6
        shx.append(struct.pack(">2i", at // 2, len(body) // 2))
        shp.append(struct.pack(">2i", k + 1, len(body) // 2) + body)
        at += 8 + len(body)
    (folder / f"{name}.shp").write_bytes(b"\0" * 100 + b"".join(shp))
    (folder / f"{name}.shx").write_bytes(b"\0" * 100 + b"".join(shx))
    fields = [("CODE", 5), ("PLACE", 12)]
    width = 1 + sum(w for _, w in fields)
    head = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(records), 32 + 32 * len(fields) + 1, width)
    head += b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in fields) + b"\r"
    rows = [(b"*" if gone else b" ") + code.encode().ljust(5) + place.encode().ljust(12) for code, place, _, gone in records]
    (folder / f"{name}.dbf").write_bytes(head + b"".join(rows))
    return str(folder / name)


def square(x, y, w=0.1):
    return [(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)]


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    draw = random.Random(5)
    records = [(str(k), f"Place {k}", [square(-84 + draw.randrange(40) / 10, 33 + draw.randrange(40) / 10)], False) for k in range(500)]
    records[7] = ("7", "", None, False)
    records[9] = ("9", "gone", records[9][2], True)
    records[11] = ("11", "Zürich", [[(x / 10 - 84, y / 10 + 33) for x, y in ring] for ring in ([(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)])], False)
    return write(tmp_path_factory.mktemp("shapes"), records, gap={3, 260}), records


@pytest.mark.parametrize("split, held", [(S.SPLIT, S.HELD), (64, 300), (1, 1)])
def test_every_record_whatever_the_splits(spark, made, monkeypatch, split, held):
    monkeypatch.setattr(S, "SPLIT", split)
    monkeypatch.setattr(S, "HELD", held)
    base, records = made
    got = {r.record: r for r in S.decoded(S.read_shapes(spark, base)).collect()}
    want = {k: r for k, r in enumerate(records) if r[2] is not None and not r[3]}
    assert set(got) == set(want)
    for k, (code, place, rings, _) in want.items():
        assert (got[k].CODE, got[k].PLACE) == (code, place)
        assert [[(p.x, p.y) for p in ring] for ring in got[k].rings] == rings
        xs, ys = zip(*(p for ring in rings for p in ring))
        assert (got[k].west, got[k].south, got[k].east, got[k].north) == (min(xs), min(ys), max(xs), max(ys))


def test_archive_and_wanted_codes(spark, made, tmp_path):
    base, records = made
    with zipfile.ZipFile(tmp_path / "zones.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for end in ("shp", "shx", "dbf"):
            z.write(f"{base}.{end}", f"inner/zones.{end.upper()}")
    shapes = S.read_shapes(spark, S.unpacked(spark, str(tmp_path / "zones.zip")))
    wanted = spark.createDataFrame([("00011",), ("00020",), ("00020",), ("99999",), ("00007",), (None,)], "postal_code string")
    got = {r.postal_code: r for r in S.zip_shapes(shapes, wanted, "CODE").collect()}
    assert set(got) == {"00011", "00020"}
    assert got["00020"].PLACE == "Place 20" and len(got["00011"].rings) == 2
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("readme.txt", "no shapes")
    with pytest.raises(ValueError):
        S.unpacked(spark, str(tmp_path / "bad.zip"))


def test_box_filters_run_before_decoding(spark, made):
    from pyspark.sql import functions as F

    rows = S.decoded(S.read_shapes(spark, made[0]).where("east > -82 and CODE <> '3'"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") > plan.index("ArrowEvalPython")  # the plan is printed from its end
    assert rows.count() == sum(r[2] is not None and not r[3] and max(x for ring in r[2] for x, _ in ring) > -82 and r[0] != "3" for r in made[1])
    ring = S.decoded(S.read_shapes(spark, made[0]).where("CODE = '11'")).select(F.lit(1).alias("k"), F.col("rings")[0].alias("ring"))
    assert abs(area(boundary(ring, ["k"]), ["k"]).first().area - 0.81) < 1e-9


def test_no_records(spark, tmp_path):
    assert S.decoded(S.read_shapes(spark, write(tmp_path, []))).count() == 0


def test_context_against_loop(spark):
    draw = random.Random(9)
    boxes = []
    for k in range(300):
        x, y = draw.randrange(-60, 60) / 8, draw.randrange(-60, 60) / 8
        boxes.append((f"{k:05d}", x, y, x + draw.choice([0.1, 0.5, 2.5]), y + draw.choice([0.1, 0.5, 2.5])))
    assigned = [(c, f"{draw.randrange(320):05d}") for c in ("a", "b", "c") for _ in range(draw.choice([1, 2, 5]))]
    boxes_df = spark.createDataFrame(boxes, "postal_code string, west double, south double, east double, north double")
    got = {(r.city, r.postal_code): r.is_assigned for r in S.context(boxes_df, spark.createDataFrame(assigned * 2, "city string, postal_code string"), "city").collect()}
    want, place = {}, {b[0]: b[1:] for b in boxes}
    for city in {c for c, _ in assigned}:
        own = [place[p] for c, p in assigned if c == city and p in place]
        if not own:
            continue
        w, s, e, n = min(b[0] for b in own), min(b[1] for b in own), max(b[2] for b in own), max(b[3] for b in own)
        px, py = max((e - w) * 0.08, 0.05), max((n - s) * 0.08, 0.05)
        for p, (bw, bs, be, bn) in place.items():
            if bw <= e + px and be >= w - px and bs <= n + py and bn >= s - py:
                want[city, p] = (city, p) in assigned
    assert got == want and len(want) > 20 and any(want.values()) and not all(want.values())
