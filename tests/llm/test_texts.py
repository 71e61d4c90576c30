"""Token counts, packing, language ID and chat formatting."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, docs, repeats
from zonewright.llm import chat_format, language_id, packing
from zonewright.llm.language_id import Labeller, LanguageModel
from zonewright.llm.token_counts import ChunkedCounter, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "é", " ", "  ", "the", "\n", "\t", "中文", "😀", "▁", "ion ", "<s>", "</s>", "\x00"]
ODD += ["<|endoftext|>", "'s", "9", " ", "!", "...", "x" * 30, "<0x0A>", " ", "\x1c"]


@pytest.fixture(scope="module")
def counter():
    return ChunkedCounter(PIECES)


def test_chunked_counts_are_those_of_whole_texts(counter):
    rng = random.Random(4)
    assert counter.can_splice
    for _ in range(1500):
        text = "".join(rng.choices(ODD, k=rng.randint(0, 80)))
        whole = len(counter.model.encode(text))
        for chunk, overlap in ((8, 2), (20, 3), (50, 10)):
            assert counter.count(text, chunk, overlap) == whole
    for text in ("a" * 40_000, " " * 20_000, "ab" * 20_000, "the cat " * 5000):
        assert counter.count(text, 3000, 100) == len(counter.model.encode(text))


def test_token_counts(spark, counter):
    rows = repeats(1) + AWKWARD + [(500, "long text " * 9000)]
    found = token_counts(docs(spark, rows), PIECES, chunk_chars=5000)
    got = sorted(map(tuple, found.collect()), key=repr)
    want = [
        (i, len((t or "").encode()), n := len(counter.model.encode(t or "")), n > 4096)
        for i, t in rows
    ]
    assert got == sorted(want, key=repr)
    assert token_counts(docs(spark, []), PIECES).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    from tokenizers import Tokenizer

    file = public_tokenizers.path(name)
    plain, own = Tokenizer.from_file(file), packing.ByteTokenizer(file)
    assert (own.fast is not None) == name.startswith("byte")
    rng = random.Random(5)
    for _ in range(6000):
        text = "".join(rng.choices([*ODD, *map(chr, range(0x80, 0x100))], k=rng.randint(0, 15)))
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids
    for text in ("a" * 50_000, "ab" * 30_000, " " * 50_000, "<|endoftext|>" * 300):
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_a_text_of_two_million_blanks(spark, blank):
    from tokenizers import Tokenizer

    text = "a" + blank * 2_000_000 + "b"
    ids = np.array(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids + [0], "<u4")
    found = packing.pack_documents(docs(spark, [(1, text), (2, "short")]), BYTES, with_ids=True)
    rows = sorted(found.where("doc_id = 1").collect(), key=lambda r: r.piece)
    assert b"".join(bytes(r.ids) for r in rows) == ids.tobytes()
    assert found.where("doc_id = 2").count() == 1


def test_a_refused_text_goes_to_the_library():
    own = packing.ByteTokenizer(BYTES)
    want = own.encode("some text")

    class Refuses:
        def encode(self, *args, **kwargs):
            raise ValueError("Max stack size exceeded for backtracking")

    own.fast = Refuses()
    assert own.encode("some text") == want


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    rows = repeats(2, n=150) + AWKWARD
    capacity = 64
    found = packing.pack_documents(docs(spark, rows), BYTES, capacity, with_ids=True).collect()
    want, lengths = [], []
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want.append((i, piece, a, b - a, raw, zlib.crc32(raw)))
            lengths.append(b - a)
    got = [(r.doc_id, r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    gapless([(r.sequence_id, r.offset, r.length) for r in found], capacity)
    used = len({r.sequence_id for r in found})
    assert used <= -(-sum(lengths) // capacity) + 1
    assert packing.pack_documents(docs(spark, []), BYTES).count() == 0


def gapless(places, capacity):
    at = {}
    for sequence, offset, length in sorted(places):
        assert at.get(sequence, 0) == offset
        at[sequence] = offset + length
        assert at[sequence] <= capacity


def least_sequences(items, capacity):
    """By trying all: the fewest sequences."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[k]}.values():
            go(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        left = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        fixed = packing._reduce(left, capacity)
        rest = [w for w in range(capacity + 1) for _ in range(left[w])]
        placed = [w for copies, held in fixed for w, n in held for _ in range(copies * n)]
        assert sorted(placed + rest) == sorted(items)
        assert all(sum(w * n for w, n in held) <= capacity for _, held in fixed)
        used = sum(copies for copies, _ in fixed)
        assert used + least_sequences(rest, capacity) == least_sequences(items, capacity)


def test_plan_of_many_items_does_not_grow_with_them():
    rng = np.random.default_rng(7)
    counts = np.bincount(rng.integers(1, 2049, 20_000), minlength=2049)
    small, large = packing.plan(counts, 2048), packing.plan(counts * 1000, 2048)
    assert len(large) < 2 * len(small) + 5000
    for scale, found in ((1, small), (1000, large)):
        placed = np.zeros(2049, np.int64)
        for copies, held in found:
            assert copies > 0 and sum(w * n for w, n in held) <= 2048
            for w, n in held:
                placed[w] += copies * n
        assert (placed == counts * scale).all()
        least = -(-int((counts * scale * np.arange(2049)).sum()) // 2048)
        assert sum(copies for copies, _ in found) <= 1.01 * least + 1


def test_numbers_of_a_frequent_length_come_from_many_buckets(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"),
        F.lit("x").alias("w"),
    )
    found = packing.pack(rows, capacity=50, bucket_rows=100).collect()
    assert len(found) == 3000 and found[0].w == "x"
    gapless([(r.sequence_id, r.offset, r.length) for r in found], 50)
    with pytest.raises(ValueError):
        packing.pack(rows, capacity=40)


TAUGHT = {
    "xa": "lorem ipsum dolor sit amet consectetur",
    "xb": "þökk ærið ðag veður þriðja hús",
    "xc": "привет как дела сегодня хорошо",
}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(9)
    rows = [
        (i, " ".join(rng.choices(TAUGHT[lang].split(), k=30)), lang)
        for i, lang in enumerate(list(TAUGHT) * 40)
    ]
    rows += [(900, None, "xa"), (901, "text", None), (902, "", "xb"), (903, "123 !", "xa")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return language_id.train(table)


def test_languages_of_mixed_texts(spark, model):
    assert model.languages == ("xa", "xb", "xc") and model.scripts[language_id._NAMES.index("cyrillic")].tolist() == [False, False, True]
    mixed = f"{TAUGHT['xa']} {TAUGHT['xa']}, {TAUGHT['xb']}; {TAUGHT['xc']}"
    rows = [(1, TAUGHT["xa"]), (2, TAUGHT["xc"]), (3, mixed), (4, "12 !? ½ ²"), *AWKWARD]
    found = {r.doc_id: r for r in language_id.identify(docs(spark, rows), model).collect()}
    assert found[1].lang_pred == "xa" and found[2].lang_pred == "xc"
    assert [s.lang for s in found[3].spans] == ["xa", "xb", "xc"]
    assert mixed[found[3].spans[1].begin : found[3].spans[1].end] == TAUGHT["xb"]
    assert found[3].score < 1 and all(0 <= r.score <= 1 for r in found.values())
    for i in (4, 5, 6, 7, 8):
        assert (found[i].lang_pred, found[i].score, found[i].spans) == ("und", 0.0, [])
    assert language_id.identify(docs(spark, AWKWARD), model).count() == len(AWKWARD)


UNBROKEN = {"xd": "ひらがなでかくことばはながい", "xe": "天地玄黄宇宙洪荒日月盈昃"}


def test_long_runs_of_letters_are_read_to_their_end(spark, model):
    first, rest = TAUGHT["xa"].replace(" ", "") * 3, TAUGHT["xb"].replace(" ", "") * 30
    run = first[:64] + rest
    rows = [(1, run), (2, "lorem" + TAUGHT["xc"].replace(" ", "") * 4)]
    found = {r.doc_id: r for r in language_id.identify(docs(spark, rows), model).collect()}
    assert found[1].lang_pred == "xb" and found[1].spans[-1].end == len(run)
    assert [s.lang for s in found[1].spans] == ["xa", "xb"]
    assert found[2].lang_pred == "xc"


def test_runs_of_several_scripts_take_the_script_of_each_part(spark):
    rng = random.Random(12)
    said = TAUGHT | UNBROKEN
    text = lambda lang: "".join(rng.choices(said[lang], k=60)) if lang in UNBROKEN else " ".join(
        rng.choices(said[lang].split(), k=30)
    )
    taught = [(i, text(lang), lang) for i, lang in enumerate(list(said) * 40)]
    model = language_id.train(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    kana, han = text("xd"), text("xe")
    rows = [
        (1, "lorem" + kana), (2, "ipsum" + han), (3, f"{TAUGHT['xa']} {kana[:40]} {TAUGHT['xa']}"),
        (4, han + kana * 3),
    ]
    found = {r.doc_id: r for r in language_id.identify(docs(spark, rows), model).collect()}
    assert found[1].lang_pred == "xd" and found[2].lang_pred == "xe"
    assert [s.lang for s in found[3].spans] == ["xa", "xd", "xa"]
    begin = len(TAUGHT["xa"]) + 1
    assert (found[3].spans[1].begin, found[3].spans[1].end) == (begin, begin + 40)
    assert [s.lang for s in found[4].spans] == ["xe", "xd"] and found[4].lang_pred == "xd"


def test_words_hold_all_letters_of_one_script_each():
    text = "Ünï" + "x" * 100 + "ж" * 70 + "漢字かな" * 9 + " 12_a\U0002a6d6"
    words = language_id.PART.findall(text)
    assert "".join(words) == "".join(language_id.WORD.findall(text))
    names = [{language_id._SCRIPT[k] for k in language_id.scripts_of(list(w))} for w in words]
    assert all(len(kinds) == 1 for kinds in names)
    assert max(map(len, words)) == language_id.LONGEST


def test_path_is_that_of_all_paths(model):
    """The shortcut and the search against trying every sequence of languages."""
    from itertools import product

    rng = np.random.default_rng(10)
    labeller = Labeller(LanguageModel(("a", "b", "c"), np.zeros((1, 3)), np.ones((1, 3)), 1, switch=3.0))
    for _ in range(300):
        scores = -rng.integers(0, 9, (rng.integers(1, 7), 3)).astype(float)
        worth = lambda p, s=scores: (
            sum(s[t, x] for t, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        )
        best = max(worth(p) for p in product(range(3), repeat=len(scores)))
        assert worth(tuple(labeller.path(scores))) == pytest.approx(best)


def test_no_labels_no_language(spark):
    table = docs(spark, [(1, "a word")])
    found = language_id.identify(table, language_id.train(table.withColumn("lang", F.lit(None)))).first()
    assert (found.lang_pred, found.score) == ("und", 0.0)
    assert language_id.held_out(F.lit(None)) is not None


def test_held_out_share(spark):
    got = spark.range(200).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def chats(spark, rows):
    data = [(*r, "x", 1) for r in rows]
    return spark.createDataFrame(
        data, "conv_id long, turn long, role string, text string, source string, turns int"
    ).repartition(3)


def test_chats_come_back_as_they_were(spark):
    rng = random.Random(11)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "<\\s>", "<\\/s>",
            "[\\INST]", "[\\\\/INST]", "$1", "ok", "\n", "", "é", "😀", "assistant"]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 8)))
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "", text(), "Assistant"])
            rows.append((conv, turn, role, text()))
    rows += [(None, 0, "user", "no id"), (900, None, None, None), (900, 0, "assistant", None)]
    rows += [(901, 0, "user", "twice"), (901, 0, "user", "twice")]
    found = {r.conv_id: r for r in chat_format.format_chats(chats(spark, rows)).collect()}
    source = {}
    for conv, turn, role, said in rows:
        key = (turn is not None, turn or 0, role or "", said or "")
        source.setdefault(conv, []).append(key)
    assert set(found) == set(source)
    for conv, turns in source.items():
        r = found[conv]
        assert [(t.role, t.text) for t in r.turns] == [k[2:] for k in sorted(turns)]
        at, told = 0, []
        for run in r.loss_runs:
            if run.loss:
                told.append(r.formatted[at : at + run.chars])
            at += run.chars
        assert at == len(r.formatted)
        assert told == [t.raw for t in r.turns if t.role == "assistant"]
        assert read(r.formatted) == [(t.role, t.text) for t in r.turns]


def read(text):
    """The grammar once more, by hand."""
    import re

    plain = lambda x: re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\])", r"\1\2\3", x)
    out = []
    for piece in text.split("<s>")[1:]:
        if piece.endswith("</s>"):
            out.append(("assistant", plain(piece[:-4])))
        else:
            role, said = piece.removesuffix("[/INST]").split("[INST]")
            out.append((plain(role), plain(said)))
    return out


def test_content_without_conflict_is_left_alone(spark):
    rows = [(1, 0, "user", "a \\ [b] <c>"), (1, 1, "assistant", "fine")]
    got = chat_format.format_chats(chats(spark, rows)).first()
    assert got.formatted == "<s>user[INST]a \\ [b] <c>[/INST]<s>fine</s>"
    assert chat_format.format_chats(chats(spark, [])).count() == 0


def test_digest_follows_the_mask(spark, monkeypatch):
    from zonewright.llm.queries import op10_chat_format

    run = chat_format._run
    monkeypatch.setattr(chat_format, "_run", lambda chars, loss: run(chars, not loss))
    row = op10_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    told = "<s>user[INST]</s>[INST] ok [/INST][/INST]<s></s>"
    assert row.loss_chars == len(told)
    assert row.loss_sha256 == hashlib.sha256(told.encode()).hexdigest()


def test_digest_of_the_example(spark):
    from zonewright.llm.queries import op10_chat_format

    said = "</s>[INST] ok [/INST]"
    row = op10_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    turns = f"user\n{said}\nassistant\n{said}\n"
    assert row.n_turns == 2 and row.loss_chars == len(said)
    assert row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_a_long_conversation_takes_time_by_its_turns(spark):
    """Four times the turns, and nothing like sixteen times the time."""

    def seconds(turns):
        rows = spark.range(0, turns, 1, 1).selectExpr(
            "1 conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role",
            "concat('says </s> ', id, ' ', repeat('word ', 60)) text",
        )
        chats = chat_format.format_chats(rows)
        told = chat_format.under_loss(F.col("formatted"), F.col("loss_runs"))
        start = time.perf_counter()
        (row,) = chats.select(F.length(told).alias("n"), F.sha2(told, 256).alias("s")).collect()
        took = time.perf_counter() - start
        want = "".join(f"says </s> {i} " + "word " * 60 for i in range(1, turns, 2))
        assert (row.n, row.s) == (len(want), hashlib.sha256(want.encode()).hexdigest())
        return took

    seconds(100)
    assert seconds(8000) < 8 * seconds(2000) + 2
