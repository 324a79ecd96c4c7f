"""Every link of the Jaccard join is counted, inside connected groups too."""

import os

from hubrisk.llm import jaccard_join as J
from hubrisk.llm import queries

from llm_helpers import LOW, SF, WORD
from test_duplicates import brute_components, near_copies


def brute_links(rows, pct=75):
    """(doc_id, set size, smallest id reached, number of linked rows) of each row."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    links = [sum(k != m and bool(a) and bool(b) and 100 * len(a & b) >= pct * len(a | b) for m, b in enumerate(sets))
             for k, a in enumerate(sets)]
    return sorted((i, len(sets[k]), links[k]) for k, (i, _) in enumerate(rows) if i is not None)


def check(got, rows):
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in got if r.doc_id is not None) == brute_links(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_all_links_of_near_copies(spark, odd, nothing):
    rows = near_copies(1, 120)
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_links int")
    check(J.jaccard_links(df, J.JoinParams(block=7)).collect(), rows)
    check(J.jaccard_links(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert J.jaccard_links(nothing).count() == 0


def test_links_query(spark, sf_docs):
    check(queries.QUERIES["op9_ngram_jaccard_links"](spark, SF).collect(), list(sf_docs.items()))


def test_small_tables_are_written_as_few_files(spark, monkeypatch):
    """Not one file a shuffle partition: on a local disk each file written takes a process of its own."""
    from hubrisk.llm import common, components as C

    written = []
    path_of = common.scratch_path
    monkeypatch.setattr(common, "scratch_path", lambda *a: written.append(path_of(*a)) or written[-1])
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(k, k + 1) for k in range(0, 400) if k % 10 != 9], "a long, b long")
        got = {r.node: r.component for r in C.components(edges).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {k: k // 10 * 10 for k in range(400)}
    files = [sum(n.startswith("part-") for n in os.listdir(p.removeprefix("file:"))) for p in written]
    assert len(files) > 4 and max(files) <= 2, files
