"""The registered queries: against SQL where there is some, and the pipeline against its parts done by brute force."""

import os
import subprocess
import sys
from pathlib import Path

import compare
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from strandweave.llm import queries, swap_packing

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import WORD, brute_spans, groups_by_brute_force, texts  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, name):
    ours = compare.rows(queries.QUERIES[name](spark, sf).toPandas())
    assert ours == compare.rows(compare.connection(sf).execute(queries.ORACLES[name]).df())


def test_all_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()


def test_secret_digest(spark, sf):
    import hashlib

    own = texts(sf)
    for r in queries.op4_secret_scan(spark, sf).collect():
        base = [s for s in brute_spans(own[r.doc_id]) if s[0] in ("assign", "access", "hex")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert docs.columns == columns
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if name == "toxicity":
            rated = {r.doc_id: r.predicted for r in queries.op9_toxic_neighbours(spark, sf).collect()}
            assert sorted(ids) == sorted(k for k in before if not rated[k])
        elif name == "near_duplicates":
            want = groups_by_brute_force({k: r.text for k, r in before.items()})
            assert sorted(ids) == sorted(set(want.values()))
        elif name == "secrets":
            assert sorted(ids) == sorted(before)
            for r in after:
                assert (r.text == before[r.doc_id].text) == (not brute_spans(before[r.doc_id].text))
                assert not brute_spans(r.text) or "[" in r.text
        else:
            kept = after
            size = sum(len(WORD.findall(r.text or "")) for r in before.values())
            assert abs(sum(len(WORD.findall(r.text or "")) for r in after) - size) < 0.2 * size
            assert all(r == before[r.doc_id] for r in after)
    got = corpus_pipeline.run(spark, sf).toPandas()
    tokens = sum(len(swap_packing.token_ids(r.text, swap_packing.Packing())) for r in kept)
    assert got.length.sum() == tokens and (got.groupby("sequence_id").length.sum() <= 1024).all()
    assert np.isin(got.doc_id, [r.doc_id for r in kept]).all()


def test_entry_without_this_part(tmp_path):
    """The driver's folders without the operators of this part still import and list the other queries."""
    root = Path(entry.__file__).parent
    code = "import sys; sys.modules['strandweave.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; n = e.queries(); assert n and not any(x.startswith('op') for x in n)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": str(root)})
