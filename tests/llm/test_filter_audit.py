"""The filter audit against a plain loop over documents and orders."""

import itertools
import random
import re
from collections import Counter

from pagespan.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask int, part string, n int"


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        docs.append((lang or "", {f for f, v in fails.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                own = [(x, g, b) for p, x, g, b in docs if p == part]
                before = set(order[: step - 1])
                here = [(x, g, b) for x, g, b in own if f in x and not x & before]
                shapley[part, f] += len(here)
                out[part, order, step] = [sum(not x & (before | {f}) for x, _, _ in own), len(here), sum(f in x and bool(x & before) for x, _, _ in own), sum(x == {f} for x, _, _ in own), sum(g for _, g, _ in here), sum(b for _, _, b in here)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_equals_a_plain_loop(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["ab", "Cd", "EFG", "h", "x$", "é", "ÉA"]) + str(rnd.randint(0, 300))
    rows = [(i, " ".join(word() for _ in range(rnd.choice([5, 99, 100, 130]))), rnd.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(100 + i, rows[i % 4][1], "en") for i in range(30)] + [(0, rows[0][1], "en"), (7, None, "de"), (8, "", None), (None, rows[1][1], "en"), (None, None, None), (300, "  \n", "fr"), (301, "a b " * 40_000, "fr")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], DOCS).repartition(3)
    lab = spark.createDataFrame([(d, None if q is None else int(q), None if t is None else int(t), 5) for d, q, t in labels], "doc_id long, quality int, toxic int, mask int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_filters(docs, lab).collect()}
    assert got == brute(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), lab).count() == 0
    assert filter_audit.audit_filters(docs, lab.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_a_part_with_zeros_and_chosen_orders(spark):
    cell = spark.createDataFrame([("x", 0, False, False, 9), ("x", 6, True, False, 2), ("y", 1, False, True, 1)], "part string, mask int, good boolean, toxic boolean, n long")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit_orders(cell, "PQR", ["QRP", "RQP"]).collect()}
    assert len(got) == 12 and got["x", "QRP", 1] == (9, 2, 0, 0, 2, 0, 2) and got["x", "QRP", 2] == (9, 0, 2, 0, 0, 0, 2) and got["y", "RQP", 3] == (0, 1, 0, 1, 0, 1, 2) and got["y", "QRP", 1] == (1, 0, 0, 0, 0, 0, 0)
