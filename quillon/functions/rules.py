"""Decision rules as Column functions: policies, verdicts, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Low-memory bound (GB) and transcription chunk (seconds) by policy.
LOW_MEMORY_GB = 10.0
CHUNK_SECONDS = {"default": 120, "low": 60, "cpu": 120}
# Media file extensions.
MEDIA = ["wav", "mp3", "flac", "m4a", "aac", "ogg", "opus", "wma", "mp4", "mkv", "webm", "mov", "avi"]


def memory_policy(forced: Column, has_gpu: Column, free_gb: Column, total_gb: Column, budget_gb: float = LOW_MEMORY_GB) -> Column:
    """A forced policy, else cpu without a GPU, else low under the budget, else default."""
    return F.when(F.coalesce(forced, F.lit("")).isin(*CHUNK_SECONDS), forced).when(~F.coalesce(has_gpu, F.lit(False)), "cpu").when(F.coalesce(free_gb, total_gb) < budget_gb, "low").otherwise("default")


def chunk_seconds(policy: Column) -> Column:
    """Transcription chunk of a policy."""
    return F.when(policy == "low", CHUNK_SECONDS["low"]).otherwise(CHUNK_SECONDS["default"])


def clean_verdict(voice_db: Column, background_db: Column) -> Column:
    """What to do with a clip by the levels of voice and background."""
    return F.when(voice_db <= -50, "kept_original").when(background_db <= -45, "already_clean").otherwise("cleaned")


def is_media(path: Column) -> Column:
    """Whether a path has a media extension."""
    return F.lower(F.element_at(F.split(path, "[.]"), -1)).isin(*MEDIA)


def same_model(a: Column, b: Column) -> Column:
    """Two names mean one model: equal without case and outer space, and not empty."""
    plain = lambda c: F.lower(F.trim(c))
    return F.coalesce((plain(a) == plain(b)) & (plain(a) != ""), F.lit(False))


def fallback(first: Column, second: Column) -> Column:
    """Which detector's spans are used: the first that has any."""
    return F.when(F.coalesce(F.size(first), F.lit(0)) > 0, "first").when(F.coalesce(F.size(second), F.lit(0)) > 0, "second").otherwise("none")


def timeout_seconds(value: Column, default: int = 1800) -> Column:
    """A timeout setting: nothing or junk is the default, zero or less is none (null)."""
    given = F.trim(value).try_cast("double")
    return F.when(value.isNull() | given.isNull(), F.lit(float(default))).when(given > 0, given)


def install_state(ready: Column, running: Column, failed: Column, missing: Column) -> Column:
    """State of a set-up row."""
    return F.when(ready, "ok").when(running, "installing").when(failed, "failed").when(missing == 0, "install").otherwise("blocked")


def vocal_stem(paths: Column) -> Column:
    """The stem to go on with: the first marked ``(vocals)``, else the first with ``vocal`` in its name; else null."""
    low = F.transform(paths, F.lower)
    marked = F.filter(F.arrays_zip(paths.alias("p"), low.alias("l")), lambda x: F.contains(x["l"], F.lit("(vocals)")))
    any_ = F.filter(F.arrays_zip(paths.alias("p"), low.alias("l")), lambda x: F.contains(x["l"], F.lit("vocal")))
    return F.coalesce(F.get(marked, F.lit(0))["p"], F.get(any_, F.lit(0))["p"])


def out_of_memory(kind: Column, message: Column) -> Column:
    """An error that smaller chunks may cure."""
    return F.coalesce((kind == "runtime") & F.contains(F.lower(message), F.lit("out of memory")), F.lit(False))


def precision(asked: Column, major: Column) -> Column:
    """Number format of recognition by what is asked for and the device's major capability (null: unknown)."""
    wanted = F.lower(F.when(F.coalesce(asked, F.lit("")) == "", "fp32").otherwise(asked))
    best = F.when(major >= 8, "bf16").when(major < 8, "fp16")
    return F.when(wanted == "auto", F.coalesce(best, F.lit("fp32"))).when(wanted == "bf16", F.coalesce(best, F.lit("bf16"))).when(wanted == "fp16", "fp16").otherwise("fp32")


def detected(policy: Column, first: Column, first_us: Column, second: Column, second_us: Column) -> Column:
    """Spans, duration and used detector (``spans, dur_us, used``) under a policy ``first``, ``second`` or ``auto``.

    Spans that are null come from a detector that failed, empty ones from one that
    heard nothing; ``auto`` (null too) goes on to the second after either.
    """
    way = F.lower(F.coalesce(policy, F.lit("auto")))
    none = F.slice(F.coalesce(first, second), 1, 0)
    total = F.when(first.isNotNull(), F.coalesce(first_us, F.lit(0))).otherwise(0).cast("long")
    heard = lambda spans: F.coalesce(F.size(spans) > 0, F.lit(False))
    second_total = F.when(second.isNotNull(), F.coalesce(second_us, F.lit(0))).cast("long")
    out = lambda spans, us, used: F.struct(spans.alias("spans"), us.cast("long").alias("dur_us"), F.lit(used).alias("used"))
    return (
        F.when((way == "second") & heard(second), out(second, second_total, "second"))
        .when(way == "second", out(F.coalesce(second, none), F.coalesce(second_total, F.lit(0)), "none"))
        .when(heard(first), out(first, total, "first"))
        .when(way == "first", out(F.coalesce(first, none), total, "none"))
        .when(heard(second), out(second, F.when(second_total > 0, second_total).otherwise(total), "second"))
        .otherwise(out(none, F.coalesce(second_total, total), "none"))
    )


def setting(default: Column, *names: Column) -> Column:
    """A setting under its name or an older one: the first that is given, else the default."""
    return F.coalesce(*names, default)


def missing(python: Column, decoder_known: Column, decoder: Column, decoder_ready: Column, folder: Column) -> Column:
    """What a run still needs, first things first: ``python``, ``decoder``, ``folder``; empty if nothing."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    no_decoder = F.coalesce(decoder_known, F.lit(False)) & ~F.coalesce(decoder, F.lit(False)) & ~F.coalesce(decoder_ready, F.lit(False))
    return F.when(blank(python), "python").when(no_decoder, "decoder").when(blank(folder), "folder").otherwise("")


def runnable(source: Column, n_references: Column, name: Column, lacking: Column, phase: Column) -> Column:
    """Whether a run can start: inputs are given, nothing is lacking, and none is under way."""
    given = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(n_references, F.lit(0)) > 0) & (F.trim(F.coalesce(name, F.lit(""))) != "")
    return given & (lacking == "") & ~F.coalesce(phase, F.lit("")).isin("running", "fetching")
