"""Whole and edited copies of benchmark items in any case, against a plain reading of the rule."""

from __future__ import annotations

from cartomill.llm import decontamination


def test_copies_in_other_case(spark):
    item = "Tom has 12 apples and gives 5 kg to Ann. How many of the 12 apples does Tom have left in the Straße, please tell"
    names = "Anna Maria Luisa Carla Berta Dora"
    torn = item.replace("12 apples does", "13 apples does").lower()
    texts = [item, item.lower(), item.upper(), names, names.lower(), torn, " ".join(item.lower().split()[:9]), item.lower().replace("gives", "lends")]
    docs = [(i, f"so it began {t} and it went on") for i, t in enumerate(texts)]
    got = decontamination.leaks(spark.createDataFrame([*docs, docs[1]], "doc_id long, text string"), spark.createDataFrame([(7, item), (8, names)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.kind, r.share) for r in got) == [(0, 7, "copy", 1.0), (1, 7, "copy", 1.0), (2, 7, "copy", 1.0), (3, 8, "copy", 1.0), (4, 8, "copy", 1.0), (7, 7, "edited", 24 / 25)]


def _plain(docs, items, share=0.8):
    """The rule by hand: every shift at which a window of five words is common, the item laid beside the document there."""
    fold = lambda t: [w for w in (x.rstrip(".,;:!?)]") for x in t.lower().replace("ß", "ss").split()) if w]
    out = set()
    for doc_id, text in docs:
        d = fold(text)
        for item_id, t in items:
            w = fold(t)
            shifts = {a - b for a in range(len(d) - 4) for b in range(len(w) - 4) if d[a : a + 5] == w[b : b + 5]}
            for s in shifts:
                near = [x for x in shifts if abs(x - s) <= max(2, int(0.2 * len(w)))]
                same = sum(any(0 <= i + x < len(d) and d[i + x] == w[i] for x in near) for i in range(len(w)))
                if same >= share * len(w):
                    out.add((doc_id, item_id))
    return out


def test_edits_against_plain_rule(spark):
    """Items without placeholders, so that only the words count: changed, added, missing and moved words at every place."""
    items = [(k, " ".join(f"w{(k * 7 + i * i) % 23}x" for i in range(n)).replace("0", "o").replace("1", "l")) for k, n in ((1, 12), (2, 20), (3, 33))]
    docs = []
    for k, t in items:
        w = t.split()
        for i in range(0, len(w), 2):
            docs += [" ".join(["before", *w[:i], "new", *w[i + 1 :], "after"]), " ".join([*w[:i], "more", "words", *w[i:]]), " ".join(w[:i] + w[i + 1 :]), " ".join(w[i:] + ["then"] + w[:i]), " ".join(x if j % 6 != i % 6 else "new" for j, x in enumerate(w))]
    docs = list(enumerate(docs))
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = _plain(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and 0 < len(want) < len(docs)
