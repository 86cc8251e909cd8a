import re
from itertools import permutations

from fieldroute.llm.filter_audit import audit
from fieldroute.session import table


def fails(text, first, own):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {k for k, x in out.items() if x} | ({"E"} if own is not None and first is not None and first < own else set())


def plain(docs, labels):
    """Every order is run over the documents."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    firsts = {}
    for d, text, _ in docs:
        if d is not None:
            firsts[text or ""] = min(d, firsts.get(text or "", d))
    parts = {}
    for d, text, part in docs:
        parts.setdefault(part or "", []).append((d, fails(text or "", firsts.get(text or ""), d)))
    out = {}
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            live = rows
            for step, f in enumerate(order, 1):
                left, gone = [r for r in live if f not in r[1]], [r for r in live if f in r[1]]
                removed_by[f] += len(gone)
                hit = sum(f in r[1] for r in rows)
                out[part, "".join(order), step] = [len(left), len(gone), hit - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                live = left
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def held(frame):
    assert frame.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = frame.collect()
    out = {tuple(r)[:3]: list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert held(audit(docs, labels)) == plain([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(300))
    docs = [(1, None, "a"), (2, "", "a"), (3, "same", "b"), (3, "same", "b"), (4, "same", None), (None, "same", ""), (None, "same", "b"), (5, long, "a"), (6, long, "c"), (7, long * 300, "c"), (8, "x " * 400, "c"), (9, "AB cd" * 3, "c"), (10, "ÄÖ é x", "é"), (11, "# " + long, "a"), (12, "only", "z"), (0, "only", "z")]
    docs += [(100 + i, "hot copy", "hot") for i in range(500)]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (4, None, 1), (None, 1, 1), (6, 1, 1), (7, 0, 0), (777, 1, 1), (110, 1, 1), (100, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, mask string, own int")
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert held(audit(frame, known)) == plain(docs, labels)
    assert audit(frame.limit(0), known).count() == 0
    assert held(audit(frame, known.limit(0))) == plain(docs, [])


def test_other_filters(spark):
    """Any filters: here two, without the one on copies."""
    frame = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "abb", "s"), (4, "c", "s")], "doc_id long, text string, source string")
    own = {"x": lambda text, words: text.contains("a"), "y": lambda text, words: text.contains("bb")}
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    got = held(audit(frame, labels, own))
    assert got["s", "xy", 1] == [2, 2, 0, 1, 1, 1, 3] and got["s", "xy", 2] == [1, 1, 1, 1, 0, 0, 3] and got["s", "yx", 1] == [2, 2, 0, 1, 1, 1, 3]
    assert len(got) == 4
