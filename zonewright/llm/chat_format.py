r"""Chat formatting with a grammar that can be read back.

    conversation := turn*
    turn         := "<s>" role "[INST]" text "[/INST]"        any role but assistant
                  | "<s>" text "</s>"                         assistant

where neither role nor text holds one of the control strings ``<s> </s> [INST] [/INST]``. These
share no first and last characters, so they cannot overlap, and the parser is deterministic:
cut at ``<s>``, look how the piece ends, cut at the first ``[INST]``. Conversations are first
rendered as they are, parsed, and compared with their source. Where that differs, content in
conflict is escaped by a backslash after the first character of a control string, one more if
there are backslashes already (``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``), which
the parser takes away again. After that every turn must be recovered as it was, else the job
stops. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.columns import col

ASSISTANT = "assistant"
BEGIN, END, INST, INST_END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = r"</?s>|\[/?INST\]"
#: Control strings with any number of backslashes after the first character.
_PATTERNS = (("<", r"(\\*)(/?s>)"), ("[", r"(\\*)(/?INST\])"))


def escape(text: Column) -> Column:
    for first, rest in _PATTERNS:
        text = F.regexp_replace(text, F.lit("\\" + first + rest), F.lit(first + r"\\$1$2"))
    return text


def unescape(text: Column) -> Column:
    for first, rest in _PATTERNS:
        text = F.regexp_replace(text, F.lit("\\" + first + r"\\" + rest), F.lit(first + "$1$2"))
    return text


def render(turns: Column, escaped: bool) -> Column:
    """The text of an array of (role, text)."""
    change = escape if escaped else lambda x: x

    def one(turn: Column) -> Column:
        said = change(turn["text"])
        return F.when(turn["role"] == ASSISTANT, F.concat(F.lit(BEGIN), said, F.lit(END))).otherwise(
            F.concat(F.lit(BEGIN), change(turn["role"]), F.lit(INST), said, F.lit(INST_END))
        )

    return F.array_join(F.transform(turns, one), "")


def parse(text: Column) -> Column:
    """The (role, text, raw) of each turn in a rendered text. ``raw`` is the text as it stands
    there; what the grammar does not allow gives nulls."""

    def one(piece: Column) -> Column:
        size, head = F.length(piece), F.instr(piece, INST)
        said = F.endswith(piece, F.lit(END))
        put = F.endswith(piece, F.lit(INST_END)) & (head > 0)
        role = F.when(said, F.lit(ASSISTANT)).when(put, F.substr(piece, F.lit(1), head - 1))
        begin = F.when(said, F.lit(1)).otherwise(head + len(INST))
        tail = F.when(said, F.lit(len(END))).otherwise(F.lit(len(INST_END)))
        raw = F.when(said | put, F.substr(piece, begin, F.greatest(size - tail - begin + 1, F.lit(0))))
        free = ~raw.rlike(CONTROL) & ~role.rlike(CONTROL)
        return F.struct(
            F.when(free, unescape(role)).alias("role"),
            F.when(free, unescape(raw)).alias("text"),
            raw.alias("raw"),
        )

    pieces = F.split(text, BEGIN, -1)
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)


def _heard(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Per conversation: the id, ``formatted``, the ``turns`` (role, text, raw) read back from
    it, and ``loss_runs``, which cuts ``formatted`` into (chars, loss) runs in code points.

    Turns are ordered by turn, role and text, null turns first; repeated rows are repeated
    turns. A null role or text counts as empty; rows with a null id make up one conversation
    with a null id. An empty table gives an empty one; other columns are not read. A
    conversation is one row, as its formatted text is one value, so each must fit a task.
    """
    turn = F.struct(
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = conversations.groupBy(col(conv_col).alias(conv_col)).agg(
        _heard(F.array_sort(F.collect_list(turn))).alias("source")
    )
    plain = render(F.col("source"), escaped=False)
    rendered = grouped.withColumn("plain", plain).withColumn(
        "formatted",
        F.when(_heard(parse(F.col("plain"))) == F.col("source"), F.col("plain")).otherwise(
            render(F.col("source"), escaped=True)
        ),
    )
    read = rendered.withColumn("turns", parse(F.col("formatted")))
    same = _heard(F.col("turns")) == F.col("source")
    broken = F.raise_error(F.lit("a conversation is not the same after formatting"))
    runs = F.flatten(
        F.transform(
            "turns",
            lambda t: F.when(
                t["role"] == ASSISTANT,
                F.array(
                    _run(F.lit(len(BEGIN)), False),
                    _run(F.length(t["raw"]), True),
                    _run(F.lit(len(END)), False),
                ),
            ).otherwise(F.array(_run(_outside(t), False))),
        )
    )
    return read.select(
        conv_col,
        F.when(same, F.col("formatted")).otherwise(broken).alias("formatted"),
        "turns",
        runs.alias("loss_runs"),
    )


def under_loss(formatted: Column, runs: Column) -> Column:
    """What ``runs`` put under the loss in a formatted text, unescaped and joined.

    Only numbers are added up along the runs; each text is then cut from its own turn, so the
    time does not grow with the length of a conversation times its turns. A run that does not lie
    in a turn of its own, as those of ``format_chats`` all do, is cut from the whole text.
    """
    none = F.array().cast("array<struct<begin:bigint,chars:bigint>>")

    def placed(sizes: Column, chars, wanted) -> Column:
        """(begin, chars) of the entries of an array that are ``wanted``."""

        def step(done: Column, x: Column) -> Column:
            here = F.array(F.struct(done["at"].alias("begin"), chars(x).alias("chars")))
            return F.struct(
                (done["at"] + chars(x)).alias("at"),
                F.when(wanted(x), F.concat(done["found"], here)).otherwise(done["found"]).alias("found"),
            )

        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"))
        return F.aggregate(sizes, start, step)["found"]

    said = placed(runs, lambda r: r["chars"], lambda r: r["loss"])
    pieces = F.split(formatted, BEGIN, -1)
    turns = F.slice(pieces, F.lit(2), F.size(pieces))
    ends = lambda t: F.endswith(t, F.lit(END))
    size = lambda t: (F.length(t) + len(BEGIN)).cast("long")
    own = F.arrays_zip(F.filter(turns, ends).alias("t"), placed(turns, size, ends).alias("p"))
    def cut(turn: Column, run: Column) -> Column:
        at = run["begin"] - turn["p"]["begin"] - len(BEGIN)
        inside = (at >= 0) & (at + run["chars"] <= F.length(turn["t"]))
        near = F.substr(turn["t"], (at + 1).cast("int"), run["chars"].cast("int"))
        far = F.substr(formatted, (run["begin"] + 1).cast("int"), run["chars"].cast("int"))
        part = F.when(inside, near).otherwise(far)
        return F.when(run["begin"].isNotNull(), unescape(part))

    # turns without a run come last and give null, which is left out
    return F.array_join(F.zip_with(own, said, cut), "")


def _run(chars: Column, loss: bool) -> Column:
    return F.struct(chars.cast("long").alias("chars"), F.lit(loss).alias("loss"))


def _outside(turn: Column) -> Column:
    marks = len(BEGIN) + len(INST) + len(INST_END)
    return F.length(escape(turn["role"])) + F.length(turn["raw"]) + marks
