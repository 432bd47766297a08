"""Every registered query of the subpackage on the smallest test tables, and the pipeline on rows with edges, against plain versions."""

import hashlib
import zlib

import duckdb
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import byte_bpe, html_main, license_scan, mixture, near_dup, queries, toxicity
from loomwright.llm.common import LOWER, UPPER, held_out
from tests.llm.test_near_dup import brute as near_brute

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(UPPER, LOWER)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoding():
    pieces = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(pieces)}, special_tokens={})


def result(spark, name):
    rows = queries.QUERIES[name](spark, SF).collect()
    return {r["doc_id"]: r for r in rows}, len(rows)


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_like_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_op1(spark, docs):
    got, n = result(spark, "op1_license_scan")
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    assert n == len(docs) and set(got) == set(docs)
    for i, r in got.items():
        assert r["n_matches"] == len(scanner.scan(docs[i]["text"])) and (r["license"] is None) == (r["dice"] == 0)


def test_op3(spark, docs, encoding):
    got, n = result(spark, "op3_byte_bpe")
    assert n == len(docs)
    for i, r in got.items():
        text = docs[i]["text"] or ""
        ids = encoding.encode_ordinary(text)
        digest = hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())


def test_op5(spark, docs):
    got, n = result(spark, "op5_language_id")
    assert n == len(docs) and all(r["held_out"] == is_held_out(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    test = [i for i in docs if is_held_out(i) and docs[i]["lang"] and got[i]["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == docs[i]["lang"] for i in test) / len(test) > 0.95


def test_op6(spark, docs):
    got, n = result(spark, "op6_lossless_webp")
    assert n == len(docs)
    for i, r in got.items():
        data = (docs[i]["text"] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_op7(spark, docs):
    got, n = result(spark, "op7_toxicity")
    assert n == len(docs) and all(r["held_out"] == is_held_out(i) and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    test = [i for i in got if is_held_out(i) and i in labels]
    assert sum(got[i]["predicted"] == labels[i] for i in test) / len(test) > 0.8


def test_op8(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = queries.op8_html_main_text(spark, SF).collect()
    assert len(got) == pages.count() and sorted(map(tuple, got)) == sorted(map(tuple, html_main.main_text(pages).collect()))
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_op9(spark, docs):
    got, n = result(spark, "op9_minhash_near_dedup")
    assert n == len(docs)
    assert sorted((i, r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()) == near_brute([(i, r["text"]) for i, r in docs.items()])


def test_op10(spark, docs):
    got, n = result(spark, "op10_token_counts")
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert n == len(docs)
    for i, r in got.items():
        text = docs[i]["text"] or ""
        count = len(model.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), count, count > 4096)


def edge_table(spark, folder):
    """The smallest documents with nulls, empty and long texts, copies and columns of clashing names."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    prose = " ".join(f"word{i % 97} other{i % 31}" for i in range(20_000))
    extra = [(900_001, None, "en", "src0", 0), (900_002, "", None, None, 0), (900_003, " \n ", "en", "src1", 3), (900_004, prose, "en", "src1", len(prose)), (900_005, prose.upper(), None, "src1", len(prose)), (900_006, prose + " end", "de", None, len(prose) + 4)]
    both = d.unionByName(spark.createDataFrame(extra, d.schema)).withColumns({c: F.lit(c) for c in ("n_tokens", "score", "_h", "id", "kept", "probability", "a.b")})
    both.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_like_plain_stages(spark, tmp_path, encoding):
    folder = f"file://{tmp_path}"
    docs = edge_table(spark, folder)
    rows = {r["doc_id"]: r for r in docs.collect()}
    got, kept = docs, dict(rows)
    # Toxicity, with the model that training gives, scored text by text.
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet").where(~held_out(F.col("doc_id"))))
    scorer = toxicity.Scorer(model)
    kept = {i: r for i, r in kept.items() if not (r["text"] or "").strip(" ") or scorer.score([r["text"]])[0] < 0.7}
    plain = [kept]
    best = {}
    for i, r in kept.items():
        t = (r["text"] or "").translate(FOLD)
        best[t] = max(best.get(t, i), i)
    kept = {i: kept[i] for i in best.values()}
    plain.append(kept)
    kept = {i: kept[i] for i, _, _, stays in near_brute([(i, r["text"]) for i, r in kept.items()]) if stays}
    plain.append(kept)
    c = duckdb.connect()
    c.register("documents", spark.createDataFrame([(i, r["text"], r["lang"], r["source"]) for i, r in kept.items()], "doc_id bigint, text string, lang string, source string").toPandas())
    drawn = c.execute(mixture.mix_sql()).df()
    kept = {i: kept[i] for i in drawn[drawn["sampled"]]["doc_id"]}
    plain.append(kept)
    for (_, stage), want in zip(corpus_pipeline.STAGES, plain):
        got = stage(spark, got, folder)
        assert got.columns == docs.columns
        assert {r["doc_id"]: r for r in got.collect()} == want
        got = spark.createDataFrame([tuple(want[i]) for i in sorted(want)], docs.schema)
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert out == {i: len(encoding.encode_ordinary(r["text"] or "")) for i, r in kept.items()}


def test_pipeline_of_an_empty_table(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, SF)
        assert got.count() == 0
