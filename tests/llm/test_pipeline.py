"""The pipeline's stages on real tables, each against a plain reading of what it must keep."""

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from keyspan.llm import decontaminate, neardup, secrets, toxicity

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, written and read again, over the documents and some odd rows."""
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    schema = docs.schema
    odd = [(900_000, None, "en", "s", 0), (900_001, "", "en", "s", 0), (None, "no id", None, None, None), (900_002, "password=hunter2hunter2 é", "en", None, 24)]
    out = [docs.unionByName(spark.createDataFrame(odd, schema))]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], DIRECTORY).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_order(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "secret_scans", "sentencepiece"]
    assert all(df.columns == kept[0].columns and df.dtypes == kept[0].dtypes for df in kept[:5])


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_toxic_documents_go(spark, kept):
    field = toxicity.train(kept[0], spark.read.parquet(f"{DIRECTORY}/labels.parquet"))
    rows = texts(kept[0])
    p, lengths, _ = toxicity.token_marginals(field, toxicity.Unary(field), [t or "" for _, t in rows])
    score = toxicity._sigmoid(toxicity.aggregate(p, lengths) @ field.curve)
    assert texts(kept[1]) == [r for r, s in zip(rows, score) if s < 0.5]


def test_one_of_each_group_stays(kept):
    from test_neardup import brute

    rows = texts(kept[1])
    extra = {i for i, least, _ in brute(rows) if i is not None and least != i}
    assert texts(kept[2]) == [r for r in rows if r[0] not in extra]


def test_no_benchmark_passage_stays(spark, kept):
    from test_decontaminate import brute

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect()]
    rows = [r for r in texts(kept[2]) if len(r[1] or "") < 8000]
    dirty = {i for i, _ in brute(rows, items)}
    assert [r for r in texts(kept[3]) if len(r[1] or "") < 8000] == [r for r in rows if r[0] not in dirty]
    assert decontaminate.contaminated(kept[3], spark.read.parquet(f"{DIRECTORY}/benchmark.parquet")).count() == 0


def test_secrets_are_masked_and_nothing_else(kept):
    before, after = dict(texts(kept[3])), dict(texts(kept[4]))
    assert before.keys() == after.keys()
    for i, text in before.items():
        spans = secrets.find_secrets(text) if text else []
        assert after[i] == (secrets.redacted(text, spans, "[SECRET]") if spans else text)
    assert after[900_002] == "[SECRET] é" and {r.doc_id: r.n_chars for r in kept[4].collect()}[900_002] == 10


def test_encoded(kept):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((i, len(model.encode(t or "", add_bos=True, add_eos=True))) for i, t in texts(kept[4])), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in kept[5].collect()), key=str) == want


CLASHES = (
    "score toxic quality label held_out predicted class class_id n_links node row rows id part chunk kind data item_id item spans "
    "train fold h n least copies keep _row _node _n Text_ sig signature prefix run place edge src dst data_ marked cut"
).split()


def staged(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, out[-1], DIRECTORY).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_an_empty_table_stays_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").where("false")
    out = staged(spark, docs, tmp_path)
    assert all(df.count() == 0 for df in out) and all(df.columns == docs.columns for df in out[:5])


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    rows = spark.read.parquet(f"{DIRECTORY}/documents.parquet").where("doc_id < 60")
    words = " ".join(f"word{i}" for i in range(40))
    # One id under two texts, one of them a copy of another row's, and one row twice.
    more = [(7_000, words, "en", "s", 1), (7_001, words, "en", "s", 1), (7_001, "a text of its own", "en", "s", 2), (7_002, "twice there", None, None, None), (7_002, "twice there", None, None, None)]
    docs = rows.unionByName(spark.createDataFrame(more, rows.schema))
    plain = staged(spark, docs, tmp_path / "plain")
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.lit(f"x{i}"))
    out = staged(spark, docs, tmp_path / "more")
    assert all(df.columns == docs.columns for df in out[:5])
    # The extra columns change no decision and are carried as they are.
    for a, b in zip(plain, out):
        assert texts(a) == texts(b) if "text" in a.columns else a.count() == b.count()
    held = out[4].select(*CLASHES).distinct().collect()
    assert [tuple(r) for r in held] == [tuple(f"x{i}" for i in range(len(CLASHES)))]
    kept = [(r.doc_id, r.text) for r in out[4].where("doc_id >= 7000").collect()]
    assert sorted(kept) == [(7_000, words), (7_001, "a text of its own"), (7_002, "twice there")]


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, DIRECTORY).collect()
    assert 0 < len(rows) <= spark.read.parquet(f"{DIRECTORY}/documents.parquet").count()
    assert neardup.THRESHOLD == 0.8 and "pipeline" in contract.queries()


def test_registered():
    names = list(contract.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(contract.oracle_sql()) <= set(names)
