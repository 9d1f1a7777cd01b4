"""Changes of documents as doc_updates delivers them."""

from datetime import datetime

from tierlake import queries


def test_update_doc_takes_the_latest_change_of_each_layer(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a, b = (r[0] for r in docs.where("text <> ''").orderBy("doc_id").select("doc_id").take(2))
    rows = [(1, a, "update", "text", '"New text"'), (2, a, "update", "pos", '["DET", "NOUN"]'), (3, a, "update", "_notes", '["x"]'), (4, b, "update", "text", '"Gone"'), (5, b, "remove", None, None), (6, b, "update", "lemma", '["y"]')]
    made = [(n, doc, 1, op, layer, datetime(2026, 1, n), datetime(2026, 1, n), payload) for n, doc, op, layer, payload in rows]
    spark.createDataFrame(made, "upd_id bigint, doc_id bigint, corpus_id int, op string, layer string, occurred_at timestamp, received_at timestamp, payload string").write.parquet(f"{tmp_path}/doc_updates.parquet")
    for t in ("documents", "annotations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    got = {r["doc_id"]: r for r in queries.queries()["update_doc"](spark, str(tmp_path)).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(before) and got[a]["text"] == "New text" and got[b]["text"] == before[b]
    assert got[a]["pos"] == "DET|NOUN" and got[a]["notes"] == '["x"]' and got[b]["lemma"] == "y"


def test_add_docs_adds_every_layer_that_has_units(spark, small):
    docs, new = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "doc_updates"))
    want = new.where("op = 'add' and layer in ('text', 'pos', 'lemma', '_notes')").select("upd_id").distinct().count()
    got = queries.queries()["add_docs"](spark, small)
    assert got.count() == docs.count() + want and got.where("pos is not null and text is null").count() > 0


def test_update_doc_tells_copies_with_one_id_apart(spark, tmp_path):
    """Copies beyond the prefixes of a code share its whole code as id; a change of one is none of the others."""
    n = 60
    docs = [(i, None, "en", "x", 0, None, 1) for i in range(n)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, url string, corpus_id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, corpus_id int, layer string, ord int, unit_from int, unit_to int, datum string, link_to int, annotator_id int").write.parquet(f"{tmp_path}/annotations.parquet")
    at = datetime(2026, 1, 1)
    made = [(i, i, 1, "update", "pos", at, at, f'["T{i}"]') for i in range(0, n, 2)]
    spark.createDataFrame(made, "upd_id bigint, doc_id bigint, corpus_id int, op string, layer string, occurred_at timestamp, received_at timestamp, payload string").write.parquet(f"{tmp_path}/doc_updates.parquet")
    rows = queries.queries()["update_doc"](spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r["pos"] for r in rows}
    assert len(rows) == n and got == {i: None if i % 2 else f"T{i}" for i in range(n)}
