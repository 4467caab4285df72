"""Registered queries against their SQL, and the stages of the pipeline."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrand.llm import decontaminate, line_dedup, near_dedup, neighbours, packing, secret_scan, toxicity
from lodestrand.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert mine == sorted(map(str, theirs))


SCHEMAS = {
    "op1_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_secret_scan": "doc_id bigint, start bigint, n_chars bigint, sha256 string, score double, secret boolean",
    "op7_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


def registered(spark, name):
    out = QUERIES[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields) == SCHEMAS[name]
    return out.toPandas()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def test_registered_neighbours(spark):
    got = registered(spark, "op1_neighbours")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    want = neighbours.brute_force(list(zip(rows.vec_id, rows.embedding, strict=True)))
    assert set(got.query_id) == set(want) and (got.groupby("query_id")["rank"].apply(lambda r: sorted(r) == list(range(1, 11)))).all()
    found = [len({i for i, _ in near} & set(got[got.query_id == q].vec_id)) for q, near in want.items()]
    assert sum(found) / sum(map(len, want.values())) >= 0.9
    assert (got.sort_values(["query_id", "rank"]).groupby("query_id").score.apply(lambda s: s.is_monotonic_increasing)).all()


def test_registered_packing(spark, docs):
    got = registered(spark, "op2_packing")
    tokenizer = packing.ChunkTokenizer(packing.tokenizer_path("word_bpe_49k.json")).tokenizer
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in range(0, len(ids), 2048)]
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(fill) <= -(-got.length.sum() // 2048) + 1


def test_registered_near_dedup(spark, docs):
    got = registered(spark, "op8_near_dedup")
    want = near_dedup.brute_force(list(zip(docs.doc_id, docs.text, strict=True)))
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_registered_language(spark, docs):
    got = registered(spark, "op7_language").merge(docs[["doc_id", "lang"]], on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() >= 0.97


def test_registered_toxicity(spark, docs):
    got = registered(spark, "op9_toxicity")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held[held.toxic == 0].predicted == 0).mean() >= 0.97
    assert (held[held.toxic == 1].predicted == 1).mean() >= 0.5


def test_toxicity_scores_equal_a_plain_walk_through_the_cascade(spark, docs):
    """The registered scores against the transducers run one after the other, clause by clause."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    terms, weights = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r["__score"] for r in toxicity.score_texts(table, "text", terms, weights).collect()}
    grammar = toxicity.Grammar(terms)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        counts = [0] * len(toxicity.PATTERNS)
        for clause in toxicity.CLAUSE.split((text or "").lower()):
            symbols = [grammar[w] for w in toxicity.WORD.findall(clause)]
            for machine in toxicity.CASCADE:
                state = 0
                for i, s in enumerate(symbols):
                    state, symbols[i] = machine.step(state, s)
            matched = [i for i, p in enumerate(toxicity.PATTERNS) if p in symbols]
            if matched:
                counts[matched[0]] += 1
        assert got[doc] == pytest.approx(toxicity.score(np.array([counts]), weights)[0])


def test_registered_secret_scan(spark, docs):
    """The tables' secrets are 40 hexadecimal characters in ``token = "..."``; card numbers and long words are none."""
    import re

    got = registered(spark, "op4_secret_scan")
    assert got.score.between(0, 1).all()
    want = {(d, m.start(1)) for d, t in zip(docs.doc_id, docs.text, strict=True) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
    found = {(r.doc_id, r.start) for r in got[got.secret].itertuples()}
    assert found == want


def test_secret_scan_equals_a_plain_scan(spark, docs):
    """The whole query against candidates found letter by letter, features counted plainly and the forest asked one by one."""
    got = {(r.doc_id, r.start): r for r in QUERIES["op4_secret_scan"](spark, SF).collect()}
    seen: dict = {}
    for t in docs.text:
        for w in set(secret_scan.LETTERS.findall((t or "").lower())):
            seen[w] = seen.get(w, 0) + 1
    dictionary = {w for w, n in seen.items() if n >= max(3, len(docs) // 2000)}
    model = secret_scan.train(spark, secret_scan.findings_frame(spark, secret_scan.labelled_findings(dictionary)))
    want = 0
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        for a, b, known in secret_scan.plain_candidates(text or ""):
            own = secret_scan.features(text[max(0, a - 40) : a], text[a:b], text[b : b + 40], dictionary, known)
            row, want = got[doc, a], want + 1
            assert (row.n_chars, row.sha256) == (b - a, hashlib.sha256(text[a:b].encode()).hexdigest())
            score = model.predictProbability(Vectors.dense(own))[1]
            assert row.score == pytest.approx(score) and row.secret == (score >= 0.5)
    assert want == len(got) > 0


def naive_pipeline(spark):
    """What the pipeline keeps, by brute force on the smallest tables (scores and packing from their operators)."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    terms, weights = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.score_texts(table, "text", terms, weights).select("doc_id", "text", "__score").collect()
    rows = [(r.doc_id, r.text) for r in scored if r["__score"] < toxicity.THRESHOLD]
    seen: dict = {}
    for i, t in rows:
        for k in set(line_dedup.line_keys((t or "").encode())[1]) - {b""}:
            seen.setdefault(k, []).append(i)
    gone = {k: min(ids) for k, ids in seen.items() if len(ids) >= 10}
    kept = [(i, t, line_dedup._kept((t or "").encode(), i, gone, True)[2].decode()) for i, t in rows]
    rows = [(i, new) for i, t, new in kept if new.strip() or not (t or "").strip()]
    near = {i: c for i, _, c, _ in near_dedup.brute_force(rows, percent=80)}
    rows = [(i, t) for i, t in rows if near[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {w[0] for w in decontaminate.brute_force(rows, items) if w[5]}
    return {i for i, _ in rows if i not in dirty}


def test_run_against_brute_force(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) == naive_pipeline(spark)
    fill = out.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(fill) <= -(-out.length.sum() // 2048) + 1


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls everywhere, repeated rows, clashing names, names with dots, a very long text, no rows."""
    rows = [(None, None, None, 1, "a", 2.0)] * 2 + [(1, "", "x", 1, "a", 2.0), (2, "clean words of a document", "x", None, None, None), (2, "clean words of a document", "x", None, None, None), (3, "w " * 300_000, "x", 1, "b", 1.0)]
    names = ["doc_id", "text", "lang", "__kept", "a.b", "__score"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __kept int, `a.b` string, __score double")
    docs = docs.withColumn("__row", F.lit(0)).withColumn("__words", F.lit("w")).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.columns[: len(names)] == names
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == (6 if name in ("toxicity", "line_dedup") else 5)
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == 4 and packed.where("doc_id = 3").count() > 100


def test_stages(spark, tmp_path):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), 201
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert 100 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_copies_in_large_groups_leave_one_row(spark, tmp_path):
    """Twelve copies with ids, one of them twice, eleven without; rows without text and a shared id are no copies."""
    rows = [(i, "Shared one\n\nshared two") for i in [*range(3, 15), 3]] + [(20, None), (21, " \n"), (22, "own words of one"), (22, "other words of another")]
    rows += [(None, f"None {k}") for k in (1, 1, 2)] + [(None, "no id\nhas it")] * 11
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("line_dedup", "near_dedup"):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    want = [(-1, "None 1"), (-1, "None 2"), (-1, "no id\nhas it"), (3, "Shared one\n\nshared two"), (20, ""), (21, " \n"), (22, "other words of another"), (22, "own words of one")]
    assert got == want
