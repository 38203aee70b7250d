"""Chat formatting in budgeted windows, and reading the turns and the loss mask back from the formatted text.

Template: a user turn is ``[INST]text[/INST]``, an assistant turn ``<s>text</s>``, any other role
``<<SYS>>role\\ntext<</SYS>>``. A backslash goes before every backslash and before every control string inside a text, so
an unescaped control string is always one of the template and unescaping gives the text back.

Windows: prefix sums of the turns' tokens cut a conversation into spans at whole turns; the span of a turn is its prefix
sum divided by the stride. Each later window begins with the conversation's system turn, if its first turn is one, and
with the turns of the span before that start in its last ``history`` tokens. Only assistant turns of the window's own
span are under the loss mask, so each is a target once. Budget = stride + history + system turn + the turn that
crosses the end of the span.

Prefix sums come from range-partitioned parts and their offsets, so a conversation of any length spreads over tasks.

Defined results: null text and null role are empty; null conversation ids form one conversation; turns are ordered by
turn, role and text with nulls first, so ties and repeated rows have a fixed order and each is kept; columns of other
names are ignored; a turn of any length stays whole, in a window of its own if need be, so the budget bounds where windows are cut and
not the length of one turn; an empty table gives no windows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ostinato.llm.ordering import dealt_in_order, part_offsets
from ostinato.runtime import partitions

# The template's control strings.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

STRIDE, HISTORY = 2048, 512
_CONTROL = "|".join(re.escape(x) for x in CONTROL)
_ESCAPE = r"(\\|" + _CONTROL + ")"
_TOKEN = re.compile(r"\\.|" + _CONTROL, re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escaped(text: F.Column) -> F.Column:
    return F.regexp_replace(text, _ESCAPE, r"\\$1")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def formatted(turns: DataFrame) -> DataFrame:
    """Adds ``head``, ``body`` and ``tail`` of each turn (columns role and text)."""
    other = F.concat(F.lit("<<SYS>>"), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    role = F.col("role")
    pick = lambda user, assistant, rest: F.when(role == "user", user).when(role == "assistant", assistant).otherwise(rest)
    return turns.withColumns(
        {
            "head": pick(F.lit("[INST]"), F.lit("<s>"), other),
            "body": escaped(F.col("text")),
            "tail": pick(F.lit("[/INST]"), F.lit("</s>"), F.lit("<</SYS>>")),
        }
    )


def parse(text: str) -> list[tuple[str, int, int]]:
    """(role, start, end) of each turn's escaped text in a formatted window."""
    out: list[tuple[str, int, int]] = []
    role, start = "", 0
    for m in _TOKEN.finditer(text):
        mark = m.group()
        if mark[0] == "\\":
            continue
        if mark in ("[INST]", "<s>"):
            role, start = ("user" if mark == "[INST]" else "assistant"), m.end()
        elif mark == "<<SYS>>":
            end = re.compile(r"\\.|\n", re.S)
            at = m.end()
            while (k := end.search(text, at)).group() != "\n":
                at = k.end()
            role, start = unescape(text[m.end() : k.start()]), k.end()
        else:
            out.append((role, start, m.start()))
    return out


def token_counter(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Counts tokens by a rank file; special tokens' strings are ordinary text."""

    def make() -> Callable[[list[str]], list[int]]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]

    return make


def with_tokens(turns: DataFrame, counter: Callable) -> DataFrame:
    """Adds ``tokens``, the count over head, body and tail."""
    schema = turns.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("head", "body", "tail")]
            tokens = count([a + b + c for a, b, c in zip(*columns, strict=True)])
            yield pa.record_batch([*batch.columns, pa.array(tokens, pa.int64())], names=[*batch.schema.names, "tokens"])

    return turns.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema) + ", tokens long")


def chat_windows(
    conversations: DataFrame, counter: Callable, stride: int = STRIDE, history: int = HISTORY
) -> DataFrame:
    """Windows: conv_id, window (from 0), text, n_turns, n_repeated (leading turns shown before), tokens, and
    loss_spans (start and end, in code points of the text, of each target)."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    placed = dealt_in_order(
        with_tokens(formatted(turns).drop("text"), counter), ["conv_id"], ["turn", "role", "body"], "chat-turns"
    )
    offsets = part_offsets(placed, ["conv_id"], F.sum("tokens"), "_before").withColumnsRenamed(
        {"conv_id": "_conv", "_part": "_of"}
    )
    inside = W.partitionBy("_part", "conv_id").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    rows = (
        placed.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_of")))
        .withColumn("_prefix", F.col("_inside") + F.col("_before"))
        .withColumn("window", F.floor(F.col("_prefix") / stride).cast("long"))
        .drop("_conv", "_of", "_inside", "_before")
    )
    first = (F.col("_prefix") == 0) & (F.col("tokens") > 0)
    used = rows.select("conv_id", "window").distinct()
    order = W.partitionBy("conv_id").orderBy("window")
    following = used.withColumn("_next", F.lead("window").over(order))
    # the window after a span need not be the next number: a long turn can pass several strides
    linked = rows.join(
        following.withColumnsRenamed({"conv_id": "_conv", "window": "_of"}),
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("window") == F.col("_of")),
    ).drop("_conv", "_of")
    own = linked.select("*", F.lit(2).alias("_kind"), F.col("window").alias("_shown"))
    system = first & ~F.col("role").isin("user", "assistant")
    late = F.col("_prefix") >= (F.col("window") + 1) * stride - history
    again = linked.where(F.col("_next").isNotNull() & late & ~system).select(
        "*", F.lit(1).alias("_kind"), F.col("_next").alias("_shown")
    )
    heads = linked.where(system).drop("window", "_next")
    kept = heads.join(
        used.where("window > 0").withColumnsRenamed({"conv_id": "_conv", "window": "_shown"}),
        F.col("conv_id").eqNullSafe(F.col("_conv")),
    ).select("*", F.lit(0).alias("_kind"))
    names = ["conv_id", "_shown", "_kind", "_part", "_at", "role", "head", "body", "tail", "tokens"]
    shown = own.select(names).unionAll(again.select(names)).unionAll(kept.select(names))
    parts = shown.groupBy("conv_id", F.col("_shown").alias("window")).agg(
        F.sort_array(F.collect_list(F.struct("_kind", "_part", "_at", "role", "head", "body", "tail", "tokens"))).alias("p")
    )
    piece = lambda x: F.concat(x["head"], x["body"], x["tail"])
    ends = F.aggregate(
        "p",
        F.array().cast("array<int>"),
        lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(piece(x))),
    )
    spans = F.filter(
        F.zip_with(
            "p",
            F.col("ends"),
            lambda x, e: F.when(
                (x["_kind"] == 2) & (x["role"] == "assistant"),
                F.struct(
                    (e - F.length(x["tail"]) - F.length(x["body"])).alias("start"), (e - F.length(x["tail"])).alias("end")
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return parts.withColumn("ends", ends).select(
        "conv_id",
        "window",
        F.concat_ws("", F.transform("p", piece)).alias("text"),
        F.size("p").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["_kind"] < 2)).alias("n_repeated"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
        spans.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the windows' text and mask alone: digests of its turns and of its targets.

    Windows of a conversation arrive in order and pass through running hashes, so none is held with the next. A digest
    over a whole conversation is one sequence by its definition; windows before it are made in parallel.
    """
    spark = windows.sparkSession
    ordered = (
        windows.select("conv_id", "window", "text", "n_repeated", F.to_json("loss_spans").alias("spans"))
        .repartition(partitions(spark), "conv_id")
        .sortWithinPartitions("conv_id", "window")
    )
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        state: list | None = None
        out: list[list] = []
        conv_type = None

        def close() -> None:
            out.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, _, text, repeated, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, start, end in parse(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{unescape(text[start:end])}\n".encode())
                for span in json.loads(spans):
                    target = unescape(text[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if len(out) >= 1000:
                yield flush()
        if state is not None:
            close()
        if conv_type is not None:
            yield flush()

    return ordered.mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
