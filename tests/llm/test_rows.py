"""Stages of the pipeline on tables with null and repeated doc_ids: each row has its own verdict."""

from strandweave.llm import simhash_dedup, toxic_neighbours

SCHEMA = "doc_id long, text string, source string"
BAD, GOOD = "vile hateful scum {} filth", "calm river {} evening walk"


def test_toxic_rows_go_alone(spark):
    words = [f"w{k}" for k in range(60)]
    docs = [(k, (BAD if k < 60 else GOOD).format(words[k % 60]), "a") for k in range(120)]
    labels = spark.createDataFrame([(k, 0, int(k < 60)) for k in range(120)], "doc_id long, quality int, toxic int")
    odd = [(None, BAD.format("x"), "n"), (None, GOOD.format("x"), "n"), (500, BAD.format("y"), "r"), (500, GOOD.format("y"), "r")]
    kept = toxic_neighbours.drop_toxic(spark.createDataFrame(docs + odd, SCHEMA), labels).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.source in "nr") == [(0, GOOD.format("x")), (500, GOOD.format("y"))]
    assert {r.doc_id for r in kept if r.source == "a"} == set(range(60, 120))


def test_each_group_keeps_a_row(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    three = " ".join(f"c{k}" for k in range(40))
    rows = [(7, two, "y"), (7, one, "x"), (3, two, "z"), (9, one, "v"), (None, one, "n"), (None, three, "m"), (None, three, "m")]
    kept = simhash_dedup.representatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text, r.source) for r in kept) == [(0, three, "m"), (3, two, "z"), (7, one, "x")]
    got = simhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id or 0, r.cluster_id or 0, r.keep) for r in got.collect()) == [(0, 0, True), (0, 0, True), (0, 7, False), (3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False)]
