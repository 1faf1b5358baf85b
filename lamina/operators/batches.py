"""Training batches: seeded order, shift and mask, padding, curricula, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chance import uniform
from ..functions.tokens import EOT, PAD, next_power, pad_or_trim
from .scan import latest, running


def autoregressive(records: DataFrame, mask_prompt: bool = True) -> DataFrame:
    """Adds xs, ys from prompt and completion: ys is xs shifted by one, 0 where the prompt is predicted."""
    full = F.concat("prompt", "completion")
    ys = F.slice(full, F.lit(2), F.size(full) - 1)
    if mask_prompt:
        ys = F.transform(ys, lambda y, i: F.when(i < F.size("prompt") - 1, F.lit(PAD)).otherwise(y))
    return records.withColumn("xs", F.slice(full, F.lit(1), F.size(full) - 1)).withColumn("ys", ys)


def all_at_once(records: DataFrame) -> DataFrame:
    """xs is the prompt, ys the completion, which must end in <EOT>."""
    ok = F.element_at("completion", -1) == EOT
    return records.withColumn("xs", F.col("prompt")).withColumn("ys", F.when(ok, F.col("completion")).otherwise(F.raise_error(F.lit("a completion must end in <EOT>")).cast("array<int>")))


def shuffled_batches(records: DataFrame, key: str, size: int, seed: int, epoch: int = 0, drop_last: bool = True, seed_text: str | None = None) -> DataFrame:
    """Adds batch_id and row_idx in an order that seed + epoch fixes.

    The order is by a hashed uniform; places along it are counted in blocks, as many as the shuffle has partitions.
    """
    d = records.withColumn("_u", uniform(F.concat_ws("|", F.lit(seed_text or str(seed + epoch)), F.col(key))))
    d = running(d, [], ["_u", key], {"_r": F.lit(1)})
    d = d.withColumn("batch_id", F.floor(F.col("_r") / size)).withColumn("row_idx", (F.col("_r") % size).cast("int"))
    if drop_last:
        d = d.join(F.broadcast(records.agg(F.count(F.lit(1)).alias("_all"))))  # one row
        d = d.where(F.col("batch_id") < F.floor(F.col("_all") / size)).drop("_all")
    return d.drop("_u", "_r")


def padded(batches: DataFrame, mode: str = "batch_max", length: int | None = None, y_pad: int = PAD) -> DataFrame:
    """Pads xs and ys to the batch's longest row, the next power of two of it, or ``length`` (an error if too short)."""
    most = F.max(F.greatest(F.size("xs"), F.size("ys"))).over(Window.partitionBy("batch_id"))
    if mode == "next_pow2":
        most = next_power(most).cast("int")
    elif mode == "global_max":
        most = F.when(most > length, F.raise_error(F.lit("a row is longer than the fixed length")).cast("int")).otherwise(F.lit(length))
    return batches.withColumn("_n", most).withColumn("xs", pad_or_trim(F.col("xs"), F.col("_n"))).withColumn("ys", pad_or_trim(F.col("ys"), F.col("_n"), y_pad)).drop("_n")


def exponential_phases(first: int, last: int, steps: int, growth: float) -> list[tuple[int, int]]:
    """(start step, greatest depth): each phase lasts ``growth`` times the one before."""
    out, at, width = [], 0.0, float(steps)
    for depth in range(first, last + 1):
        out.append((int(round(at)), depth))
        at, width = at + width, width * growth
    return out


def linear_phases(first: int, last: int, steps: int) -> list[tuple[int, int]]:
    return [(k * steps, d) for k, d in enumerate(range(first, last + 1))]


def with_phase(steps: DataFrame, phases: list[tuple[int, int]], step: str = "step") -> DataFrame:
    """Adds d_max: that of the last phase that has begun. Phases must start at 0."""
    if not phases or min(p for p, _ in phases) != 0:
        raise ValueError("a curriculum starts at step 0")
    out = F.lit(None).cast("int")
    for start, depth in sorted(phases):
        out = F.when(F.col(step) >= start, F.lit(depth)).otherwise(out)
    return steps.withColumn("d_max", out)


def with_phase_of(steps: DataFrame, phases: DataFrame, by: list[str], step: str = "step", start: str = "start", depth: str = "d_max") -> DataFrame:
    """Adds the depth of the last phase that has begun, from a table of phases (``by``, start, depth) of any size, such as one
    curriculum a user; null before the first."""
    return latest(steps, phases, by, step, start, [depth])


def manual_phases(phases: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Phases (start step, greatest depth) as given, checked: the first starts at 0, steps rise, depths are 1 or more."""
    steps = [s for s, _ in phases]
    if not phases or steps[0] != 0 or steps != sorted(set(steps)) or any(d < 1 for _, d in phases):
        raise ValueError("phases start at step 0, rise, and have depths of 1 or more")
    return list(phases)


def up_to_depth(records: DataFrame, steps: DataFrame, phases: list[tuple[int, int]]) -> DataFrame:
    """Records (distance) that each step (step) may draw on: those up to its phase's depth; one row a pair of step and record's distance."""
    own = with_phase(steps, phases)
    depths = records.select("distance").distinct()
    return own.join(F.broadcast(depths), F.col("distance") <= F.col("d_max"))  # distances are few


def batched(records: DataFrame, objective: str, mask_prompt: bool = True) -> DataFrame:
    """xs and ys by objective: autoregressive or all_at_once."""
    if objective not in ("autoregressive", "all_at_once"):
        raise ValueError(f"no objective {objective!r}")
    return autoregressive(records, mask_prompt) if objective == "autoregressive" else all_at_once(records)


def mapped(batches: DataFrame, xs=None, ys=None) -> DataFrame:
    """Batches with other inputs and targets, each a function of the old column."""
    out = batches
    for name, f in (("xs", xs), ("ys", ys)):
        out = out.withColumn(name, f(F.col(name))) if f else out
    return out


def one_completion(records: DataFrame, seed: str, key: str) -> DataFrame:
    """Adds completion, one of completions by seed and key; a record with one keeps that."""
    at = F.floor(uniform(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))) * F.size("completions")).cast("int") + 1
    return records.withColumn("completion", F.element_at("completions", at))


def resolved_length(explicit: int | None, metadata: int | None, bound: int | None) -> int:
    """The fixed length of rows: as given, else the longest that the data's metadata names, else what the bank allows."""
    for n in (explicit, metadata, bound):
        if n is not None:
            return int(n)
    raise ValueError("no length is known")


def split_chunk(rows: DataFrame, key: str, parts: int, seed: str) -> DataFrame:
    """Adds chunk: contiguous parts of a seeded order, the first ones a row longer where it doesn't divide.

    The order is worked out as in ``shuffled_batches``, so no task sorts all rows.
    """
    d = shuffled_batches(rows, key, 1, 0, drop_last=False, seed_text=seed)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(F.broadcast(n))  # one row
    short, longer = F.floor(F.col("_n") / parts), F.col("_n") % parts
    at = F.col("batch_id")
    chunk = F.when(at < longer * (short + 1), F.floor(at / (short + 1))).otherwise(longer + F.floor((at - longer * (short + 1)) / F.greatest(short, F.lit(1))))
    return d.withColumn("chunk", (chunk + 1).cast("int")).drop("batch_id", "row_idx", "_n")
