"""Near copies whose rows are repeated: a pair of sets is verified once."""

from aggrolens.llm import jaccard_join


def test_repeated_rows(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    near = [*base[:100], "other", *base[101:]]
    rows = [(i, " ".join(t)) for i, t in ((1, base), (2, near)) for _ in range(300)] + [(3, "a text of its own kind")]
    seen = []
    kept = jaccard_join.texts_of

    def watched(docs, wanted):
        out = kept(docs, wanted)
        seen.append((wanted.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "texts_of", watched)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 601 and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}
    assert seen and all(a == b for a, b in seen)
