"""Chat formatting in windows with a token budget.

Turns are marked by a template; control strings inside texts are escaped, so that reading back is exact.
A turn of more than ``turn_tokens`` is cut into parts marked as going on. Prefix sums of the tokens put
each part into window floor(prefix / stride); the stride leaves room for the whole first system turn, which
every window repeats, for the last ``history`` tokens of the window before, which are repeated with their
targets masked, and for one part that crosses the border. Tokens are those of the formatted part: escaped text, role and
control strings. So every window keeps within ``budget`` and cuts at turns only.

Prefix sums are made in blocks of turn numbers, with one sum per block exchanged, so one conversation may
hold any share of the rows; a window is at most ``budget`` tokens.

Defined results: a null text is empty, a null role is empty; turns come by number, those with the same
number by role and by a hash of the text; a null number comes first, a null conversation is one
conversation; equal rows are turns each; further columns are not read; an empty table gives no windows. Of a first system turn that
leaves no room in the budget only the leading parts are repeated, as far as one part of ``turn_tokens`` still fits beside them
and the history; the whole turn stands once, and ``system_cut`` marks such a conversation's windows. A role cannot be cut: where
it takes over half of ``turn_tokens``, its texts are cut to that half and a window may pass the budget by the roles in it.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringwave.llm.packing import default_tokenizer, tokenizer_ids
from ringwave.llm.registry import query, table
from ringwave.llm.text import bounded, texts
from ringwave.session import cut_lineage

#: The template's control strings.
START, MORE, END = "<|im_start|>", "<|im_more|>", "<|im_end|>"
TURN = re.compile(r"<\|im_(start|more)\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No control string is left: a backslash is doubled and ``<|`` is parted by one."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def _parts(path: str, turn_tokens: int):
    """Escaped texts of all turns, long ones in parts, each with its tokens and those of the whole turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer_ids(path)

        def count(text: str) -> int:
            return len(ids_of([text])[0]) // 4

        def cut(text: str, marks: int) -> list[tuple[str, int]]:
            body = escape(text)
            n = count(body)
            if n <= max(turn_tokens - marks, turn_tokens // 2) or len(text) < 2:
                return [(body, n + marks)]
            half = len(text) // 2
            return cut(text[:half], marks) + cut(text[half:], marks)

        frames: dict[str, int] = {}

        def marks(role: str) -> int:
            """Tokens of the control strings and the role, the longer start taken."""
            if role not in frames:
                n = max(count(f"{start}{role}\n") for start in (START, MORE)) + count(f"{END}\n")
                if len(frames) > 1000:
                    frames.clear()
                frames[role] = n
            return frames[role]

        for batch in bounded(batches, "body"):
            rows = []
            roles = [escape_role(r) for r in texts(batch, "role")]
            for i, text in enumerate(texts(batch, "body")):
                found = cut(text, marks(roles[i]))
                whole = sum(n for _, n in found)
                rows += [(i, k, t, n, whole) for k, (t, n) in enumerate(found)]
            at, part, body, n, whole = zip(*rows)
            at = pa.array(at)
            role = pa.array(roles)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv").take(at), batch.column("turn").take(at), role.take(at), batch.column("tie").take(at),
                 pa.array(part, pa.int32()), pa.array(body), pa.array(n, pa.int64()), pa.array(whole, pa.int64())],
                ["conv", "turn", "role", "tie", "part", "body", "tokens", "whole"])

    return run


def format_windows(rows: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", budget: int = 4096, history: int = 512, turn_tokens: int = 1024,
                   block_turns: int = 1024) -> DataFrame:
    """``conv, window, formatted, loss, n_repeated, tokens, system_cut``: one row per window.

    ``loss`` holds start and end (characters) of the targets; the first ``n_repeated`` parts of a window
    were in an earlier one.
    """
    if budget - history - 2 * turn_tokens < 1:
        raise ValueError("the budget must exceed the history and two turns")
    turns = rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.xxhash64(text_col).alias("tie"), F.coalesce(text_col, F.lit("")).alias("body"))
    parts = turns.mapInArrow(
        _parts(tokenizer, turn_tokens), "conv long, turn long, role string, tie long, part int, body string, tokens long, whole long")
    parts = parts.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**62))))
    order = ["turn", "role", "tie", "part"]
    sums = parts.groupBy("conv", "block").agg(
        F.sum("tokens").alias("n"), F.min(F.struct("turn", "role", "tie", "whole")).alias("head"))
    in_conv = W.partitionBy("conv").orderBy("block")
    before = sums.select(
        F.col("conv").alias("_conv"), F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(in_conv.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.first("head").over(in_conv.rowsBetween(W.unboundedPreceding, 0)).alias("head"))
    # room for the first system turn; as for any part where it is shorter or missing
    system_tokens = F.when(F.col("head.role") == "system", F.greatest("head.whole", F.lit(turn_tokens))).otherwise(turn_tokens)
    room = budget - history - turn_tokens - system_tokens
    # of a system turn without room its first parts are repeated, beside which one part of any turn fits
    system_room = budget - history - 2 * turn_tokens
    system_cut = room < 1
    first_turn = (F.col("role") == "system") & F.col("turn").eqNullSafe(F.col("head.turn")) & (
        F.col("role") == F.col("head.role")) & (F.col("tie") == F.col("head.tie"))
    in_block = W.partitionBy("conv", "block").orderBy(*order)
    placed = (
        parts.withColumn("inner", F.sum("tokens").over(in_block.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens"))
        .withColumn("rank", F.row_number().over(in_block))
        .join(before, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
        .withColumn("prefix", F.col("base") + F.col("inner"))
        .withColumn("system_cut", system_cut)
        .withColumn("stride", F.when(system_cut, turn_tokens).otherwise(room).cast("long"))
        .withColumn("window", F.floor(F.col("prefix") / F.col("stride")))
        .withColumn("system", first_turn)
        .drop("_conv", "_block", "base", "inner", "head", "whole")
    )
    placed = cut_lineage(placed, codec="zstd")  # four readers below, and the tokens come from Python
    own = placed.withColumn("repeated", F.lit(0))
    again = placed.where(F.col("prefix") >= (F.col("window") + 1) * F.col("stride") - history).withColumns(
        {"window": F.col("window") + 1, "repeated": F.lit(1)})
    # all parts of the first system turn, once where equal rows tell it twice
    system = placed.where("system").dropDuplicates(["conv", "part"]).where(~F.col("system_cut") | (F.col("prefix") + F.col("tokens") <= system_room))
    windows = placed.where("window > 0").select(F.col("conv").alias("_conv"), F.col("window").alias("_window")).distinct()
    kept = system.join(windows, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("window") < F.col("_window"))).withColumns(
        {"window": F.col("_window"), "repeated": F.lit(2)}).drop("_conv", "_window")
    every = own.unionByName(again).unionByName(kept)

    inside = F.array_sort(F.collect_list(F.struct(
        (-F.col("repeated")).alias("place"), "prefix", "turn", "rank", "part", "role", "body", "tokens")))
    grouped = every.groupBy("conv", "window").agg(
        inside.alias("p"), F.min("repeated").alias("new"), F.first("system_cut").alias("system_cut"))
    grouped = grouped.where("new = 0")
    # parts of the system turn may also lie in the history; they stand once
    grouped = grouped.withColumn("p", F.filter("p", lambda x: ~((x["place"] == -1) & F.exists("p", lambda y: (y["place"] == -2) & (y["prefix"] == x["prefix"]) & (y["rank"] == x["rank"])))))

    def head(x: Column) -> Column:
        return F.concat(F.when(x["part"] > 0, F.lit(MORE)).otherwise(F.lit(START)), x["role"], F.lit("\n"))

    text = F.transform("p", lambda x: F.concat(head(x), x["body"], F.lit(END + "\n")))
    grouped = grouped.withColumns({"t": text, "size": F.transform(text, lambda t: F.char_length(t))})

    def target(x: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("size", 1, i), F.lit(0), lambda a, n: a + n) + F.char_length(head(x))
        return F.when((x["place"] == 0) & (x["role"] == "assistant"), F.struct(start.alias("start"), (start + F.char_length(x["body"])).alias("end")))

    return grouped.select(
        "conv", F.col("window").cast("long"), F.array_join("t", "").alias("formatted"),
        F.filter(F.transform("p", target), lambda s: s.isNotNull()).alias("loss"),
        F.size(F.filter("p", lambda x: x["place"] < 0)).alias("n_repeated"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"), "system_cut")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows come in order; only running digests are kept of a conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv, state, rows, open_ = None, None, [], False

    def put() -> None:
        if state:
            if state["turns"]:
                state["all"].update(b"\n")
            rows.append((conv, state["turns"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

    for batch in batches:
        for r in batch.to_pylist():
            if not open_ or r["conv"] != conv:
                put()
                conv, open_ = r["conv"], True
                state = {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
            state["chars"] += len(r["formatted"])
            for k, (mark, role, body) in enumerate(TURN.findall(r["formatted"])):
                if k < r["n_repeated"]:
                    continue
                if mark == "start":
                    if state["turns"]:
                        state["all"].update(b"\n")
                    state["turns"] += 1
                    state["all"].update(unescape_role(role).encode() + b"\n")
                state["all"].update(unescape(body).encode())
            for s in r["loss"]:
                target = unescape(r["formatted"][s["start"] : s["end"]])
                state["loss_chars"] += len(target)
                state["loss"].update(target.encode())
        if len(rows) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows = []
    put()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: its turns, its targets and their digests."""
    ordered = windows.select("conv", "window", "formatted", "loss", "n_repeated").repartition("conv").sortWithinPartitions("conv", "window")
    return ordered.mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query("op6_chat")
def op6_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_windows(rows.unionByName(more), default_tokenizer()))
