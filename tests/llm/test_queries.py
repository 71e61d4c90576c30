"""The registered queries against their SQL, or against brute force where SQL has no words."""

import hashlib
import zlib
from collections import Counter
from functools import reduce
from operator import or_
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import bytes_brute, lines_brute, words_brute
from tests.llm.test_search import classes, item_words
from tests.llm.test_texts import gapless
from zonewright.llm import language_id
from zonewright.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def documents(db):
    return db.sql("select doc_id, text from documents").fetchall()


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def rows(spark, name, *columns):
    df = queries()[name](spark, SF)
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("name", oracle_sql())
def test_same_rows_as_sql(spark, db, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = Counter(tuple(r) for r in df.select(columns).collect())
    assert got == Counter(tuple(r[i] for i in order) for r in want.fetchall())
    if name != "op7_benchmark_decontamination":
        assert got


@pytest.mark.parametrize("name", ["op7_benchmark_decontamination", "op10_chat_format"])
def test_no_python_on_the_main_path(spark, plan, name):
    text = plan(queries()[name](spark, SF))
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_bytes(spark, documents):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted((*r[:4], sha(r[4])) for r in bytes_brute(documents, 100))
    assert rows(spark, "op1_suffix_array_dedup", *columns) == want


def test_words(spark, documents):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    want = sorted((*r[:3], sha(r[3])) for r in words_brute(documents, 13))
    assert rows(spark, "op2_substring_dedup", *columns) == want


def test_near_copies(spark, documents):
    assert rows(spark, "op5_ngram_jaccard_join", "doc_id", "class_id", "n_links") == sorted(classes(documents))


def test_tokens(spark, documents):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    want = [(i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in documents]
    got = rows(spark, "op6_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == sorted(want)


def pieces(documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in documents:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())


def same_packing(found, documents):
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    assert got == sorted(pieces(documents))
    gapless([(r.sequence_id, r.offset, r.length) for r in found], 2048)
    least = -(-sum(r.length for r in found) // 2048)
    assert len({r.sequence_id for r in found}) <= least + 1


def test_packing(spark, documents):
    same_packing(queries()["op8_best_fit_packing"](spark, SF).collect(), documents)


def test_languages(spark, db):
    found = queries()["op9_language_id"](spark, SF).collect()
    lang = dict(db.sql("select doc_id, lang from documents").fetchall())
    assert len(found) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    unseen = [r for r in found if r.held_out]
    right = sum(r.lang_pred == lang[r.doc_id] for r in unseen)
    assert right >= 0.95 * len(unseen) and all(0 <= r.score <= 1 for r in found)


def test_top_k_of_all_vectors(spark, db):
    """Recall against brute force is 1: the rows are the same."""
    assert len(rows(spark, "op4_exact_top_k", "query_id", "rank")) == 20 * 25


def test_pipeline(spark, db, documents):
    """Every stage on what the one before it kept, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, documents
    items = [item_words(t) for (t,) in db.sql("select text from benchmark").fetchall()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, SF))
        assert docs.columns == columns
        if name == "language ID":
            left = [(i, t) for i, t in left if language_id.WORD.search(t)]
        elif name == "line dedup":
            kept = [(r[0], r[3], r[2]) for r in lines_brute(left)]
            left = [(i, t) for i, t, lost in kept if not lost or any(c.isalnum() for c in t)]
        elif name == "n-gram Jaccard join":
            first = {i for i, c, _ in classes(left) if i == c}
            left = [(i, t) for i, t in left if i in first]
        else:
            held = lambda t: any(5 * len(g & item_words(t)) >= 4 * len(g) for g in items if g)
            left = [(i, t) for i, t in left if not held(t)]
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        assert got == sorted(left), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    same_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), left)


AWKWARD = """
    select * from values
        (1L, 'ein Satz mit vielen Worten hier', 'xa', 's', 31L),
        (1L, 'ein Satz mit vielen Worten hier', 'xa', 's', 31L),
        (2L, 'ein Satz mit vielen Worten hier', 'xa', null, null),
        (3L, null, null, null, null), (4L, '', 'xa', 's', 0L), (5L, '123', null, 's', 3L),
        (cast(null as bigint), 'ohne Nummer, aber mit Worten', 'xb', 's', 28L)
        t(doc_id, text, lang, source, n_chars)"""


def test_pipeline_on_awkward_rows(spark, tmp_path):
    spark.sql(AWKWARD).write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("select 1L item_id, cast(null as string) text").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in found), key=str) == [1, None]


@pytest.mark.parametrize("several", [3, 4])
def test_languages_of_documents_that_stay(spark, several):
    taught = ["lorem ipsum dolor sit amet consectetur", "þökk ærið ðag veður þriðja hús",
              "привет как дела сегодня хорошо", "καλημέρα τι κάνεις σήμερα φίλε"][:several]
    rows = [(i, " ".join([t] * 5), f"x{k}") for k, t in enumerate(taught) for i in range(40)]
    size = 90
    equal = " ".join((" ".join([t] * 5))[:size] for t in taught)
    rows += [(1000, equal, None), (1001, "გამარჯობა როგორ ხარ დღეს", None), (1002, "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    left = corpus_pipeline.by_language(spark, docs, SF)
    assert left.columns == docs.columns
    assert [r.doc_id for r in left.where("doc_id >= 1000").collect()] == [1000]
    assert left.where("doc_id < 1000").count() == 40 * several


def test_documents_without_id_that_hold_a_test_item_go(spark, tmp_path):
    item = " ".join(f"wort{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    docs = spark.createDataFrame(
        [(None, f"vorher {item} nachher"), (None, "ganz ohne Aufgabe aber mit Worten"), (None, None),
         (1, item), (2, "noch ein Text ohne jede Aufgabe")],
        "doc_id long, text string",
    )
    left = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    want = [(2, "noch ein Text ohne jede Aufgabe"), (None, None), (None, "ganz ohne Aufgabe aber mit Worten")]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)


def test_near_copies_without_id_or_under_one_id(spark):
    """Rows are judged by themselves: neither a null nor a repeated id saves a copy."""
    text = " ".join(f"wort{i}" for i in range(60))
    near, other = text + " ende", " ".join(f"ander{i}" for i in range(30))
    rows = [(5, text), (None, near), (None, near + " ende"), (None, other), (7, other), (7, near), (None, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(5, text), (7, other), (None, None), (8, None)], key=str)
    alone = spark.createDataFrame([(None, text), (None, near)], docs.schema)
    assert corpus_pipeline.without_near_copies(spark, alone, SF).count() == 1


def test_columns_of_any_name_pass_the_stages(spark):
    names = ["score", "spans", "lang_pred", "certainty", "_own", "kept", "first", "row", "id", "told", "label"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, more, SF)
        assert found.columns == more.columns
        wrong = [F.col(n) != F.concat(F.lit(n), F.col("doc_id")) for n in names]
        assert 0 < found.count() == found.select("doc_id").intersect(stage(spark, docs, SF).select("doc_id")).count()
        assert found.where(reduce(or_, wrong)).isEmpty()


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.sql(AWKWARD).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("select 1L item_id, 'x' text").limit(0).write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
