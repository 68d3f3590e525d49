"""The pipeline's near copies also take op10's SimHash links."""

import corpus_pipeline
from tests.llm.test_overlaps import brute_kept
from threadlake.llm.simhash import near_duplicates, simhash


def test_simhash_links(spark):
    """Texts of the same 3-word shingles in other numbers: SimHashes within two bits, 5-word sets unlike."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = {1: "a b a b a b a b a b", 2: "b a b a b a", 3: base, 4: base + " w40", 5: "c d e"}
    rows |= {6: " ".join(["p"] * 400 + ["r"]), 7: " ".join(["p"] * 400 + ["s t u v x y"])}
    assert bin(simhash(rows[6]) ^ simhash(rows[7])).count("1") <= 2 and {6, 7} <= set(brute_kept(rows))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}
    comps = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert 6 in kept and 7 not in kept
    assert kept <= {d for d, c in comps.items() if d == c} and kept <= set(brute_kept(rows))
