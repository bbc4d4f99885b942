"""Settings: stored text rows to a typed row with defaults, all that is wrong with one, and back."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import paths, template

# Settings where none are stored, regions, what to do with sources, and bitrates to choose from.
DEFAULTS = {
    "input_dir": "/input",
    "output_dir": "/output",
    "completed_subdir": "",
    "cleanup_mode": "leave",
    "path_template": "{author}/{series_name}/{Book series_position:00 - }{title}/{title} [{asin}]",
    "metadata_provider": "audnexus",
    "audnexus_url": "https://api.audnex.us",
    "region_default": "us",
    "worker_concurrency": 1,
    "bitrate_kbps": 0,
    "encoder": "aac",
    "write_chapters_txt": True,
    "retag_move_default": True,
}
REGIONS = ("us", "ca", "uk", "au", "fr", "de", "jp", "it", "in", "es")
CLEANUP_MODES = ("leave", "move", "delete")
RATES = (0, 64, 96, 128, 192, 256, 320)
ENCODERS = ("aac", "fdkaac")
# Two records that show what a template makes, one with a series and one without.
SAMPLES = {
    "series": {"author": "J.K. Rowling", "narrator": "Jim Dale", "title": "Harry Potter and the Sorcerer's Stone", "series_name": "Harry Potter", "series_position": "1", "year": "2015", "asin": "B017V4IM1G"},
    "standalone": {"author": "Andy Weir", "narrator": "Ray Porter", "title": "Project Hail Mary", "year": "2021", "asin": "B08G9PRS1K"},
}


def process_config(env: dict[str, str] | None = None) -> dict[str, str | int | bool]:
    """What the environment says of folders, tools and the port; unset, empty or unreadable values keep their defaults."""
    env = dict(os.environ) if env is None else env
    out: dict[str, str | int | bool] = {"port": 8684, "dev": False, "converter": "real", "config_dir": "/config", "input_dir": "/input", "output_dir": "/output", "completed_dir": "/completed", "ffmpeg_path": "ffmpeg", "ffprobe_path": "ffprobe", "tone_path": "tone", "fdkaac_path": "fdkaac"}
    for key, default in out.items():
        raw = env.get(key.upper(), "").strip()
        if not raw:
            continue
        if isinstance(default, bool):
            out[key] = raw.lower() in ("1", "t", "true")
        elif isinstance(default, int):
            out[key] = int(raw) if raw.isascii() and raw.isdigit() else default
        else:
            out[key] = raw
    return out


def typed(rows: DataFrame, by: tuple[str, ...] = (), **defaults) -> DataFrame:
    """One typed row from (key, value) text rows, or one for each ``by``. A stored text counts even where it is empty; a number that is none is not."""
    pivot = rows.groupBy(*by).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in DEFAULTS])

    def column(k: str, default) -> Column:
        if isinstance(default, bool):
            return F.coalesce(F.col(k) == "true", F.lit(default)).alias(k)
        if isinstance(default, int):
            return F.coalesce(F.when(F.col(k).rlike("^[+-]?[0-9]+\\z"), F.col(k).try_cast("int")), F.lit(default)).alias(k)
        return F.coalesce(F.col(k), F.lit(default)).alias(k)

    return pivot.select(*by, *[column(k, d) for k, d in (DEFAULTS | defaults).items()])


def subfolder_problem(sub: Column) -> Column:
    """Why a folder name may not stand below its root; ''."""
    s = text.trimmed(sub)
    clean = paths.cleaned_path(s)
    leaves = clean.isin("..", ".") | F.startswith(clean, F.lit("../"))
    return F.when(s == "", "").when(s.rlike("[\\\\:]"), "backslash or drive letter").when(F.startswith(s, F.lit("/")), "absolute path").when(leaves, "leaves its root").otherwise("")


def completed_path(root: Column, sub: Column) -> Column:
    """Where finished sources go: the root, or a folder below it."""
    s = text.trimmed(sub)
    return F.when(s == "", paths.cleaned_path(root)).otherwise(paths.cleaned_path(F.concat(root, F.lit("/"), paths.cleaned_path(s))))


def problems() -> Column:
    """All that is wrong with a row of typed settings, in the order of the form."""
    c = F.col
    sub, tmpl = subfolder_problem(c("completed_subdir")), template.problem_of(c("path_template"))
    return F.array_compact(
        F.array(
            F.when(text.trimmed(c("input_dir")) == "", "input_dir: empty"),
            F.when(text.trimmed(c("output_dir")) == "", "output_dir: empty"),
            F.when(~c("cleanup_mode").isin(*CLEANUP_MODES), "cleanup_mode: unknown"),
            F.when(sub != "", F.concat(F.lit("completed_subdir: "), sub)),
            F.when(tmpl != "", F.concat(F.lit("path_template: "), tmpl)),
            F.when(c("metadata_provider") != DEFAULTS["metadata_provider"], "metadata_provider: unknown"),
            F.when(~c("audnexus_url").rlike("^https?://"), "audnexus_url: no web address"),
            F.when(~c("region_default").isin(*REGIONS), "region_default: unknown"),
            F.when((c("worker_concurrency") < 1) | (c("worker_concurrency") > 8), "worker_concurrency: not 1 to 8"),
            F.when(~c("bitrate_kbps").isin(*RATES), "bitrate_kbps: not offered"),
            F.when(~c("encoder").isin(*ENCODERS), "encoder: unknown"),
        )
    )


def submitted(form: Column) -> Column:
    """Settings from a form's text values (a map): what a browser sends, trimmed, boxes that are not ticked off."""
    get = lambda k: F.coalesce(F.try_element_at(form, F.lit(k)), F.lit(""))
    whole = ("cleanup_mode", "metadata_provider", "region_default", "encoder")
    out = []
    for k, default in DEFAULTS.items():
        if isinstance(default, bool):
            value = get(k) == "on"
        elif isinstance(default, int):
            value = F.coalesce(F.when(get(k).rlike("^[+-]?[0-9]+\\z"), get(k).try_cast("int")), F.lit(0))
        elif k == "completed_subdir":
            value = F.regexp_replace(text.trimmed(get(k)), "^/+|/+$", "")
        else:
            value = get(k) if k in whole else text.trimmed(get(k))
        out.append(value.alias(k))
    return F.struct(*out)


def as_rows(settings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, value) text rows of typed settings."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in DEFAULTS])
    return settings.select(*by, F.inline(entries))


def save(settings: DataFrame, root: str) -> None:
    """Store a row of valid settings as one version of the table, all keys together; refuse others."""
    from ..sources import tables

    if wrong := settings.select(F.array_join(problems(), "; ").alias("p")).where("p <> ''").first():
        raise ValueError(f"invalid settings: {wrong['p']}")
    tables.replace(as_rows(settings), root)


def load(spark: SparkSession, root: str, **defaults) -> DataFrame:
    from ..sources import tables

    return typed(tables.read(spark, root, "key string, value string"), **defaults)


def preview(path_template: str) -> dict[str, Column]:
    """What a template makes of the two samples; null where nothing is left."""
    made = {k: template.rendered(path_template, {n: F.lit(v) for n, v in sample.items()}) for k, sample in SAMPLES.items()}
    return {k: F.concat(c, F.lit(".m4b")) for k, c in made.items()}


def agent_region(region: Column) -> Column:
    """A region a caller asks for, the first one where it is unknown."""
    r = F.lower(F.coalesce(region, F.lit("")))
    return F.when(r.isin(*REGIONS), r).otherwise("us")


def source_key(settings: DataFrame) -> DataFrame:
    """The settings with what their catalog clients depend on; a change of it means new clients."""
    return settings.withColumn("client", F.concat_ws("|", "metadata_provider", F.regexp_replace("audnexus_url", "/+$", ""), "region_default"))


def effective_shift(spec: Column, legacy_ms: Column) -> Column:
    """A job's chapter shift: its spec, or the fixed offset that older jobs carry."""
    mode = F.coalesce(spec["mode"], F.lit(""))
    none = F.lit(0).cast("long")
    old = F.coalesce(legacy_ms, none)
    return F.when(mode != "", spec).otherwise(
        F.struct(
            F.when(old != 0, "fixed").otherwise("").alias("mode"),
            old.alias("fixed_ms"),
            F.lit(0).alias("from_idx"),
            none.alias("from_ms"),
            F.lit(0).alias("to_idx"),
            none.alias("to_ms"),
        )
    )
