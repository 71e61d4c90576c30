"""Language identification of mixed texts.

A word is a run of letters of one script; longer runs are cut into several words, all of them
scored. The Unicode range of its letters narrows the languages it can belong to; character
n-grams score it for these; Viterbi over the words of a text, with a
penalty for each switch, labels its spans. The language of the text is the one whose spans
hold most letters.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import chunks

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: First code point of each range and its script; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
)
_STARTS = np.array([first for first, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
#: Position in _NAMES of each range's script.
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS])
#: Most letters of a word, and of one in scripts that may be written without blanks.
LONGEST, LONGEST_UNBROKEN = 32, 8
UNBROKEN = {"thai", "kana", "han", "other"}


def _parts() -> re.Pattern:
    """Runs of letters cut at changes of script and at the most letters of a word."""
    ends = [first for first, _ in SCRIPTS[1:]] + [0x110000]
    others: dict[str, list[str]] = {name: [] for _, name in SCRIPTS}
    for (first, own), end in zip(SCRIPTS, ends, strict=True):
        for name in others:
            if name != own:
                others[name].append(f"\\U{first:08x}-\\U{end - 1:08x}")
    kinds = [
        rf"[^\W\d_{''.join(ranges)}]{{1,{LONGEST_UNBROKEN if name in UNBROKEN else LONGEST}}}"
        for name, ranges in others.items()
    ]
    return re.compile(rf"(?=[^\W\d_])(?:{'|'.join(kinds)})")


PART = _parts()


def scripts_of(words: list[str]) -> np.ndarray:
    """Position in SCRIPTS of each word's first letter, which has the script of the others."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return np.searchsorted(_STARTS, first, side="right") - 1


def gram_buckets(words: list[str], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash bucket) of all character n-grams of the words, their ends marked."""
    marked = [f"^{w}$" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    of = np.repeat(np.arange(len(words)), sizes)
    code = np.zeros(len(chars), np.uint64)
    places, found = [], []
    for n in range(1, longest + 1):
        code = code[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        whole = np.flatnonzero(of[: len(code)] == of[n - 1 :])
        mixed = (code[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        places.append(of[whole])
        found.append((mixed >> np.uint64(20)) % np.uint64(buckets))
    return np.concatenate(places), np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """``weights[b, l]``: log probability of bucket b in language l. Bounded: buckets times
    languages, however much text it was learned from."""

    languages: tuple[str, ...]
    weights: np.ndarray
    scripts: np.ndarray  # [script, l]: whether the language is written in it
    longest: int
    switch: float


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_language: int = 4000,
    max_languages: int = 200,
    buckets: int = 1 << 15,
    longest: int = 3,
    switch: float = 8.0,
) -> LanguageModel:
    """Learn from labelled rows; rows with a null text or language teach nothing.

    The model is fitted on a bounded sample: about ``sample_per_language`` rows of each
    language, those whose text has a small hash (all rows of a language that has fewer).
    More than ``max_languages`` languages are an error. No rows give a model without languages.
    """
    spark = docs.sparkSession
    rows = docs.select(
        col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang")
    ).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {
        r["lang"]: r["n"]
        for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    }
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = tuple(sorted(counts))
    if not languages:
        none = np.zeros((len(_NAMES), 0), bool)
        return LanguageModel((), np.zeros((buckets, 0), np.float32), none, longest, switch)
    share = spark.createDataFrame(
        [(lang, min(1.0, sample_per_language / counts[lang])) for lang in languages],
        "lang string, share double",
    )
    sample = (
        rows.join(F.broadcast(share), "lang")
        .where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
        .select("lang", "text")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words[lang].update(PART.findall(text.lower()))
                if len(words[lang]) > 200_000:
                    yield from told(lang, words.pop(lang))
        for lang, found in words.items():
            yield from told(lang, found)

    def told(lang: str, found: Counter) -> Iterator[pd.DataFrame]:
        known, times = list(found), np.fromiter(found.values(), np.int64, len(found))
        if not known:
            return
        counts, letters = np.zeros(buckets), np.zeros(len(SCRIPTS))
        for a in range(0, len(known), 20_000):  # a slice of words at a time bounds the memory
            part, n = known[a : a + 20_000], times[a : a + 20_000]
            of, bucket = gram_buckets(part, longest, buckets)
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            counts += np.bincount(bucket, n[of], buckets)
            letters += np.bincount(scripts_of(part), n * sizes, len(SCRIPTS))
        for kind, total in (("gram", counts), ("script", letters)):
            at = np.flatnonzero(total)
            n = total[at].astype(np.int64)
            yield pd.DataFrame({"lang": lang, "kind": kind, "key": at, "n": n})

    learned = (
        sample.mapInPandas(count, "lang string, kind string, key long, n long")
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most (buckets + scripts) x languages rows
    )
    at = {lang: i for i, lang in enumerate(languages)}
    total = np.zeros((buckets, len(languages)))
    gram = learned[learned["kind"] == "gram"]
    total[gram["key"], gram["lang"].map(at)] = gram["n"]
    smooth = 0.5
    weights = np.log(total + smooth) - np.log(total.sum(axis=0) + smooth * buckets)
    seen = learned[learned["kind"] == "script"]
    letters = np.zeros((len(_NAMES), len(languages)))
    np.add.at(letters, (seen["key"].map(_SCRIPT.__getitem__), seen["lang"].map(at)), seen["n"])
    main = letters >= 0.01 * letters.sum(axis=0)
    some = letters > 0
    scripts = np.where(main.any(axis=1)[:, None], main & some, some)
    return LanguageModel(languages, weights.astype(np.float32), scripts, longest, switch)


class Labeller:
    """Labels texts with a model."""

    #: The most a language can lose on a word, so that no single word outweighs a switch.
    FOREIGN = -6.0

    def __init__(self, model: LanguageModel) -> None:
        self.model = model

    def word_scores(self, words: list[str]) -> np.ndarray:
        """For each word its log probability per language, that of the best candidate being 0."""
        weights, count = self.model.weights, len(self.model.languages)
        of, bucket = gram_buckets(words, self.model.longest, len(weights))
        out = np.stack([np.bincount(of, weights[bucket, x], len(words)) for x in range(count)], 1)
        near = self.model.scripts[_SCRIPT[scripts_of(words)]]
        foreign = ~near & near.any(axis=1)[:, None]
        out[foreign] = -np.inf
        out -= out.max(axis=1)[:, None]
        out[~near.any(axis=1)] = 0.0  # a script no language was seen in tells nothing
        return np.maximum(out, self.FOREIGN)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best sequence of languages.

        Leaving the language that is best on the whole costs a switch, so it pays only within
        stretches in which the best other languages gain more than that. Words in no such
        stretch keep it, and the search goes only over the runs of the others.
        """
        main, penalty = int(scores.sum(axis=0).argmax()), self.model.switch
        path = np.full(len(scores), main)
        if scores.shape[1] == 1:
            return path
        gain = np.delete(scores, main, axis=1).max(axis=1) - scores[:, main]
        summed = np.concatenate([[0.0], np.cumsum(gain)])
        lowest = np.minimum.accumulate(summed[:-1])
        highest = np.maximum.accumulate(summed[:0:-1])[::-1]
        wanted = np.flatnonzero(highest - lowest > penalty)
        if len(wanted):
            for run in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1):
                a, b = int(run[0]), int(run[-1]) + 1
                path[a:b] = self._search(scores[a:b], main, a > 0, b < len(scores))
        return path

    def _search(self, scores: np.ndarray, main: int, before: bool, after: bool) -> np.ndarray:
        """Viterbi over some words, with ``main`` before and after them where told."""
        penalty, own = self.model.switch, np.arange(scores.shape[1])
        leave = np.where(own == main, 0.0, penalty)
        back = np.empty(scores.shape, np.int64)
        best = scores[0] - leave if before else scores[0]
        for t in range(1, len(scores)):
            top = int(best.argmax())
            stay = best >= best[top] - penalty
            back[t] = np.where(stay, own, top)
            best = np.where(stay, best, best[top] - penalty) + scores[t]
        path = np.empty(len(scores), np.int64)
        path[-1] = (best - leave if after else best).argmax()
        for t in range(len(scores) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list]]:
        """Language, score from 0 to 1, spans (first character, end, language) and the certainty
        of the spans of each."""
        nothing = (UNKNOWN, 0.0, [], 0.0)
        if not self.model.languages:
            return [nothing] * len(texts)
        found = [_words(t or "") for t in texts]
        known: dict[str, int] = {}
        ids = [[known.setdefault(w, len(known)) for w in words] for words in found]
        if not known:
            return [nothing] * len(texts)
        every = list(known)
        slices = [every[a : a + 20_000] for a in range(0, len(every), 20_000)]
        scores = np.concatenate([self.word_scores(x) for x in slices])
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        seen = self.model.scripts.any(axis=1)[_SCRIPT[scripts_of(every)]]
        return [
            self._one(t, words, scores[at], sizes[at], seen[at]) if words else nothing
            for t, words, at in zip(texts, found, ids, strict=True)
        ]

    def _one(
        self, text: str, words: list[str], scores: np.ndarray, sizes: np.ndarray, seen: np.ndarray
    ) -> tuple:
        languages = self.model.languages
        path = self.path(scores)
        letters = np.bincount(path, weights=sizes, minlength=len(languages))
        main = int(letters.argmax())
        sure = np.zeros(len(languages))
        for x in np.flatnonzero(letters):
            own = scores[path == x].sum(axis=0)
            sure[x] = 1.0 / np.exp(np.minimum(own - own[x], 50.0)).sum()
        told = np.bincount(path, weights=sizes * seen, minlength=len(languages))
        certainty = float(sure @ told / told.sum()) if told.any() else 0.0
        cuts = (np.flatnonzero(np.diff(path)) + 1).tolist()
        if cuts:
            at = _places(text)
        else:  # only the ends are needed
            begin = WORD.search(text).start()
            at = [(begin, len(text) - WORD.search(text[::-1]).start())] * len(words)
        spans = [
            {"begin": at[a][0], "end": at[b - 1][1], "lang": languages[path[a]]}
            for a, b in zip([0, *cuts], [*cuts, len(path)], strict=True)
        ]
        return languages[main], float(sure[main] * letters[main] / letters.sum()), spans, certainty


def _words(text: str) -> list[str]:
    """The words in lower case; none if there is no letter among them, as in a lone fraction."""
    low = text.lower()
    words = PART.findall(low if len(low) == len(text) else text)
    if len(low) != len(text):
        words = [w.lower() for w in words]
    return words if any(c.isalpha() for w in words for c in w) else []


def _places(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    return [m.span() for m in PART.finditer(low if len(low) == len(text) else text)]


def identify(
    docs: DataFrame, model: LanguageModel, keep: Sequence[str] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """Per row: the columns ``keep``, ``lang_pred``, ``score``, ``spans`` (begin, end, lang) and
    ``certainty``.

    The score is the share of letters in spans of that language times the model's certainty
    of it. The certainty is that of the languages of all spans, by their letters; letters of
    scripts that no language was seen in do not count, and a text of only these has 0. A null
    text, one without letters, or a model without languages gives ``und``, zeros and no spans.
    One row out for each row in; kept columns pass unchanged, nulls included, and must not have
    the names of the new ones, see ``labelled``; other columns are not read.
    """
    clash = {"lang_pred", "score", "spans", "certainty"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"columns to keep are named like new ones: {sorted(clash)}")
    return labelled(docs, model, keep, text_col).select("kept.*", "label.*")


def labelled(
    docs: DataFrame, model: LanguageModel, keep: Sequence[str], text_col: str = "text"
) -> DataFrame:
    """The same as two structs, ``kept`` and ``label``, so that no names can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see LanguageModel
    kind = (
        "lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>, "
        "certainty double"
    )

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for batch in batches:
            values = ["" if t is None else t for t in batch]
            rows = [r for _, part in chunks(values, values, 1 << 18) for r in labeller.label(part)]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "spans", "certainty"])

    kept = F.struct(*[col(c) for c in keep]).alias("kept")
    return docs.select(kept, label(col(text_col).cast("string")).alias("label"))


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))
