"""Filter audit: against applying every order of filters to the documents one after the other."""

from itertools import permutations

from corrie.llm import filter_audit
from corrie.llm.filter_audit import COPY, swaps, walk

LONG = " ".join(f"word{i}" for i in range(210))
TEXTS = ["", None, "a b c", LONG, LONG, LONG + " $", "Aa " * 250, "AB cd\x0bef gh " * 60, "Ä " * 300, "x" * 5000 + "|", LONG.upper()]
SOURCES = ["s", None, "", "t", "s", "t", "s", "t", None, "s", "t"]
DOCS = "doc_id long, text string, source string, part int, mask string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "m", 2) for i, t, s in rows], DOCS)


def fails(rows, i):
    key, text, _ = rows[i]
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    copy = key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in text for c in "#$%&*|"), COPY: copy}


def brute(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    found = set()
    for part in {s or "" for _, _, s in rows}:
        own = [(rows[i][0], fails(rows, i)) for i in range(len(rows)) if (rows[i][2] or "") == part]
        orders, total = {}, dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive, steps = list(own), []
            for x in order:
                gone = [d for d in alive if d[1][x]]
                alive = [d for d in alive if not d[1][x]]
                steps.append((x, len(alive), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
                total[x] += len(gone)
            orders["".join(order)] = steps
        found |= {(part, name, k + 1, *s[1:], total[s[0]]) for name, steps in orders.items() for k, s in enumerate(steps)}
    return found


def test_every_order_of_filters(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(TEXTS, SOURCES))] + [(3, LONG, "t"), (None, LONG, "s"), (7, "other", "s")]
    labels = [(0, 1, 0), (3, 1, 1), (4, None, 1), (4, 1, 0), (None, 1, 1), (99, 1, 1), (9, 0, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.filter_audit(table(spark, rows), frame).collect()]
    assert len(got) == len(set(got)) == 3 * 120 * 5 and set(got) == brute(rows, labels)


def test_no_documents(spark):
    assert filter_audit.filter_audit(table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(set(permutations(range(n))))


def test_shares_add_up():
    counts = {0: (5, 1, 0), 1: (2, 0, 0), 3: (4, 1, 2), 7: (1, 0, 0), 4: (3, 0, 1)}
    orders, shares = walk("xyz", counts)
    assert len(orders) == 6 and sum(shares.values()) == 6 * 10 and all(steps[-1].kept == 5 for _, steps in orders)
