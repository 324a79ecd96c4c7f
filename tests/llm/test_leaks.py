"""Decontamination: leaks that single rules would lose, and a brute-force version of the matching."""

import random

from hubrisk.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
FILL = "plain words that stand before and after the passage and never occur in any of the items here".split()


def found(spark, docs, items, p=D.LeakParams()):
    got = D.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), p)
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_number_dense_items_and_verbatim_copies(spark):
    dense = "compute 12, 7, 30, 5 and 44 then 9 6 3 2"
    docs = [(1, f"{' '.join(FILL)} {dense} {' '.join(FILL)}"), (2, dense.replace("30", "31").replace("44", "45").replace("6", "8")), (3, "1 2 3 4 5 6 7 8 9 10 11")]
    assert found(spark, docs, [(1, dense)]) == {(1, 1)}


def test_one_value_in_two_roles_changed_apart(spark):
    item = ("a farmer sells 5 crates of red apples at the morning market and keeps the rest for the family while the neighbour "
            "who came along buys 5 baskets of pears and walks home along the river before noon")
    leak = item.replace("5 crates", "6 crates").replace("5 baskets", "8 baskets")
    mixed = "take 8 red beads and then 9 blue beads and 6 green beads from the box"
    assert found(spark, [(1, leak), (2, mixed)], [(1, item), (2, "take 5 red beads and then 5 blue beads and 5 green beads from the box")]) == {(1, 1)}


def test_a_long_part_of_a_longer_item(spark):
    rnd = random.Random(4)
    item = ["w" + "".join(rnd.choices("abcdefghij", k=5)) for _ in range(100)]
    docs = [(1, " ".join(FILL + item[20:65] + FILL)), (2, " ".join(FILL + item[20:50] + FILL)),
            (3, " ".join(FILL + item[:20] + FILL + item[40:60] + FILL))]
    assert found(spark, docs, [(7, " ".join(item))]) == {(1, 7)}


def test_names_that_begin_sentences(spark):
    item = "Maria buys a ticket for the train. Peter waits at the old gate. Laura counts the coins in her bag. Simon reads the map again."
    leak = item.replace("Maria", "Nadia").replace("Peter", "Oskar").replace("Laura", "Wanda").replace("Simon", "Felix")
    assert found(spark, [(1, leak), (2, leak.lower()), (3, item.lower())], [(1, item)]) == {(1, 1), (3, 1)}


def plain(docs, items, p):
    """The same rules with loops over all windows of all pairs."""
    seen, out = D.Tokens(), set()

    def tokens(text):
        at, _, kinds = seen.of(text)
        return [(seen.values[a], int(k)) for a, k in zip(at, kinds, strict=True)]

    def shape(window, names):
        slots = [(v, k if names or k != D.NAME else D.LITERAL) for v, k in window]
        if 2 * sum(k == D.LITERAL for _, k in slots) >= len(slots):
            return ("t", *[v if k == D.LITERAL else k for v, k in slots]), [v for v, k in slots if k != D.LITERAL]
        return (None if names else ("x", *[v for v, _ in slots])), []
    for item, text in items:
        it = tokens(text)
        size = min(len(it), p.window)
        if len(it) < p.min_tokens:
            continue
        for doc, body in docs:
            dt, hits = tokens(body), {}
            for i in range(len(it) - size + 1):
                for names in (True, False):
                    a, own = shape(it[i:i + size], names)
                    for d in range(len(dt) - size + 1):
                        b, new = shape(dt[d:d + size], names)
                        if a is not None and a == b and len(set(own)) == len(set(zip(own, new, strict=True))):
                            hits.setdefault(d - i, set()).add(i)
            covered = set().union(*hits.values()) if hits else set()
            run = max((sum(1 for k in range(len(it)) if set(range(i, i + k + 1)) <= s) for s in hits.values() for i in s), default=0)
            if 100 * len(covered) // (len(it) - size + 1) >= p.min_cover or run + p.window - 1 >= p.run_tokens:
                out.add((doc, item))
    return out


def test_equals_the_plain_rules(spark):
    rnd = random.Random(9)
    vocabulary = ["the", "of", "train", "costs", "Anna", "Ben", "Paris", "km", "hours", "and", "5", "7", "12", "so", "."]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 5, 8, 12, 30])))) for i in range(12)]
    docs = []
    for d in range(250):
        words = rnd.choice(items)[1].split()
        a, b = sorted((rnd.randrange(len(words)), rnd.randrange(len(words) + 1)))
        part = [rnd.choice(vocabulary) if rnd.random() < 0.08 else w for w in words[a:b]]
        docs.append((d, " ".join(rnd.choices(vocabulary, k=rnd.randrange(8)) + part + rnd.choices(vocabulary, k=rnd.randrange(8)))))
    p = D.LeakParams(window=5, run_tokens=9)
    want = plain(docs, items, p)
    assert found(spark, docs, items, p) == want and len(want) > 20
