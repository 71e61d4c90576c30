r"""Secrets in texts, and the parts of credentials that only count together.

Three kinds of parts stand for themselves: values assigned to a telling name (``assign``), access
identifiers (``access``) and long hex strings (``hex``). Three further kinds are weak: random
looking keys (``key``), logins and mail addresses (``login``), and addresses of services
(``endpoint``). Prose and code are full of those, so a weak part is only reported as part of a
credential. Every part plays a role, identifier, secret or endpoint. Two parts meet when they lie
in one scope (a stretch of text without an empty line) and at most ``reach`` code points apart.
A weak part is reported when it meets

* a part of another role that stands for itself, or
* parts of both other roles, weak ones included.

1. One pass over the texts finds the matches of each kind. What is kept of a match is how far it
   lies behind the one before it, its length and whether it is good; that table is stored.
2. Places are running sums over the matches of a kind, scopes running counts of empty lines.
3. Parts are put into cells of ``reach`` code points, and an interval join within a cell finds
   those that meet. Parts of a kind do not overlap and have a least length, so a cell holds a
   bounded number of them, and the join grows with the number of parts, not its square.

Patterns take time in proportion to the text: repetitions that may fail at their end are bounded
or begin with something fixed. Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.columns import col
from zonewright.llm.common import keep

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
#: Between a name and its value; the same for all assignments.
_IS = r"""["']?\x20*[:=]\x20*["']?"""


def any_case(words: str) -> str:
    """A pattern for ASCII letters in either case, without other characters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@dataclass(frozen=True)
class Kind:
    """``group`` of a match of ``pattern`` must be ``least`` to ``most`` long, and random looking
    (a digit, a capital and a small letter) if ``mixed``, else the match is dropped."""

    name: str
    role: str
    pattern: str
    least: int
    group: int = 0
    most: int = 1 << 30
    mixed: bool = False
    strong: bool = False
    #: a match holds one of these; looking for them is much cheaper than looking for matches
    needs: tuple[str, ...] = ()

    def good(self, value: Column) -> Column:
        ok = F.length(value).between(self.least, self.most)
        if self.mixed:
            ok &= value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
        return ok


# The first three kinds, by which results are compared.
KINDS = (
    Kind("assign", SECRET, f"({any_case('password|passwd|secret|token|api_?key')}){_IS}([A-Za-z0-9+/_.=-]+)",
         6, group=2, strong=True, needs=("=", ":")),
    Kind("access", IDENTIFIER, "AKIA[A-Z0-9]+", 20, strong=True, needs=("AKIA",)),
    Kind("hex", SECRET, "[0-9a-f]{24,}", 24, strong=True),
    Kind("key", SECRET, "[A-Za-z0-9+/_-]{16,}", 16, most=128, mixed=True),
    Kind("login", IDENTIFIER, f"({any_case('username|user|login|account|client_?id')}){_IS}[A-Za-z0-9_.@-]+"
         r"|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{1,190}", 1, needs=("=", ":", "@")),
    Kind("endpoint", ENDPOINT, r"(https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+"
         r"|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{1,5})?", 1),
)
#: What parts two scopes.
BREAK = r"\n[\x20\t\r]*\n"
_BREAK = len(KINDS)
_RUN = "array<struct<gap:int,size:int,ok:boolean>>"


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    if not kind.needs:
        return found
    able = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in kind.needs])
    return F.when(able, found).otherwise(F.array().cast("array<string>"))


def _run(text: Column, pattern: str, whole: Column, ok: Column) -> Column:
    """(gap, size, ok) of each match; ``whole`` and ``ok`` have an entry per match."""
    cut = F.zip_with(
        F.split(text, pattern, -1),
        F.zip_with(whole, ok, lambda w, k: F.struct(F.length(w).alias("size"), k.alias("ok"))),
        lambda p, m: F.struct(F.length(p).alias("gap"), m["size"].alias("size"), m["ok"].alias("ok")),
    )
    # the piece behind the last match belongs to none
    return F.when(F.size(whole) > 0, F.filter(cut, lambda x: x["size"].isNotNull())).otherwise(
        F.array().cast(_RUN)
    )


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, runs): a number for the row, and (kind, run) for the kinds that count."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        col(id_col).alias("id"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    def has(chosen) -> Column:
        some = [F.exists(f"ok{i}", lambda x: x) for i, k in enumerate(KINDS) if chosen(k)]
        return reduce(lambda a, b: a | b, some)

    def with_good(df: DataFrame, wanted: dict[int, Column]) -> DataFrame:
        none = F.array().cast("array<string>")
        found = {f"v{i}": F.when(w, _matches(F.col("text"), KINDS[i])).otherwise(none) for i, w in wanted.items()}
        df = df.select("*", *[v.alias(name) for name, v in found.items()])
        return df.select("*", *[F.transform(f"v{i}", KINDS[i].good).alias(f"ok{i}") for i in wanted])

    # keys are the costliest to find, and only count beside another role
    first = [i for i, k in enumerate(KINDS) if not k.mixed]
    good = with_good(rows, dict.fromkeys(first, F.lit(True)))
    beside = has(lambda k: not k.mixed and k.role != SECRET)
    good = with_good(good, {i: beside for i, k in enumerate(KINDS) if k.mixed})

    # weak parts can only be reported where another role is present
    roles = sum(has(lambda k, r=r: k.role == r).cast("int") for r in (IDENTIFIER, SECRET, ENDPOINT))
    told = good.withColumn("linked", roles > 1)
    text, none = F.col("text"), F.array().cast(_RUN)
    out = []
    for i, k in enumerate(KINDS):
        whole = F.col(f"v{i}")
        if k.group:
            whole = F.when(F.size(whole) > 0, F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)))
            whole = F.coalesce(whole, F.array().cast("array<string>"))
        wanted = has(lambda other, k=k: other is k)
        if not k.strong:
            wanted &= F.col("linked")
        out.append(F.when(wanted, _run(text, k.pattern, whole, F.col(f"ok{i}"))).otherwise(none))
    empty = F.regexp_extract_all("text", F.lit(BREAK), F.lit(0))
    breaks = _run(text, BREAK, empty, F.transform(empty, lambda _: F.lit(True)))
    out.append(F.when(F.col("linked"), breaks).otherwise(none))
    runs = F.array(*[F.struct(F.lit(i).alias("kind"), run.alias("run")) for i, run in enumerate(out)])
    return told.select("row", "id", F.filter(runs, lambda r: F.size(r["run"]) > 0).alias("runs"))


def _parts(runs: DataFrame) -> DataFrame:
    """(row, scope, kind, start, end) of the good matches."""
    each = runs.select("row", F.explode("runs").alias("r")).select(
        "row", F.col("r.kind").alias("kind"), F.posexplode("r.run").alias("at", "m")
    )
    so_far = Window.partitionBy("row", "kind").orderBy("at")
    placed = each.withColumn(
        "end", F.sum((F.col("m.gap") + F.col("m.size")).cast("long")).over(so_far)
    ).where("m.ok")
    placed = placed.withColumn("start", F.col("end") - F.col("m.size"))
    above = Window.partitionBy("row").orderBy("start", F.col("kind").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    scope = F.sum((F.col("kind") == _BREAK).cast("long")).over(above)
    return placed.select("row", scope.alias("scope"), "kind", "start", "end").where(
        F.col("kind") < _BREAK
    )


def _of_kind(kind: Column, value) -> Column:
    return F.element_at(F.array(*[F.lit(value(k)) for k in KINDS]), kind + 1)


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts that are reported."""
    told = parts.select(
        "*",
        _of_kind(F.col("kind"), lambda k: k.role).alias("role"),
        _of_kind(F.col("kind"), lambda k: k.strong).alias("strong"),
    )

    def cells(begin: Column, end: Column) -> Column:
        first = F.floor(F.greatest(begin, F.lit(0)) / reach)
        return F.explode(F.sequence(first, F.floor(end / reach))).alias("cell")

    weak = told.where("not strong").select(
        "row", "scope", "kind", "role", "start", "end", cells(F.col("start"), F.col("end"))
    )
    others = told.select(
        "row",
        "scope",
        F.col("role").alias("role2"),
        "strong",
        F.col("start").alias("start2"),
        F.col("end").alias("end2"),
        cells(F.col("start") - reach, F.col("end") + reach),
    )
    meets = (F.col("role") != F.col("role2")) & (F.col("start2") <= F.col("end") + reach)
    meets &= F.col("end2") >= F.col("start") - reach
    met = weak.join(others, ["row", "scope", "cell"]).where(meets)
    return (
        met.groupBy("row", "kind", "start", "end")
        .agg(F.max("strong").alias("strong"), (F.min("role2") != F.max("role2")).alias("both"))
        .where("strong or both")
        .select("row", "kind", "start", "end")
    )


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200
) -> DataFrame:
    """(id, spans): per document an array of (kind, strong, start, end), ordered by start and
    kind as listed in ``KINDS``; places count code points, the end is exclusive.

    One row per row of ``docs``, repeated rows and null ids included. A null or empty text has
    no spans, an empty table gives an empty one, other columns are not read, so their names do
    not matter. Matches of different kinds may overlap; those of one kind are leftmost and do
    not. A text is one row and its spans one value, so each must fit a task.
    """
    runs = keep(_runs(docs, id_col, text_col))
    parts = _parts(runs)
    base = parts.where(_of_kind(F.col("kind"), lambda k: k.strong)).drop("scope")
    spans = base.unionByName(_linked(parts, reach))
    per_doc = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found")
    )
    named = F.transform(
        F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")),
        lambda s: F.struct(
            _of_kind(s["kind"], lambda k: k.name).alias("kind"),
            _of_kind(s["kind"], lambda k: k.strong).alias("strong"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        ),
    )
    joined = runs.select("row", "id").join(per_doc, "row", "left")
    return joined.select(F.col("id").alias(id_col), named.alias("spans"))


def told(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")
