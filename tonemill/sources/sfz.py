"""SFZ text files as tables.

`lines` reads the files as text with line numbers; sections, opcodes and
inheritance are window functions and expressions over them (`sections`,
`regions`). Only ``#include`` needs a loop, of at most MAX_DEPTH joins of the
few lines that include something.

Defined cases: ``//`` starts a comment; a line may hold several headers and
opcodes; a value runs to the next opcode or header, so it may hold spaces;
``#define`` lines are passed over; a missing include counts as empty; unknown
headers and opcodes are reported by `unknown`, not acted on.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.zones import inherit, note_number

MAX_DEPTH = 16
# The opcodes that are read, and other names for some of them.
OPCODES = "sample lokey hikey pitch_keycenter lovel hivel tune transpose pitch_keytrack volume pan amp_veltrack loop_mode offset end loop_start loop_end ampeg_delay ampeg_attack ampeg_hold ampeg_decay ampeg_sustain ampeg_release cutoff resonance fil_veltrack fil_type group off_by".split()
ALIASES = {"loopmode": "loop_mode", "loopstart": "loop_start", "loopend": "loop_end", "pitch": "tune", "polyphony_group": "group", "offby": "off_by"}
HEADERS = ("control", "global", "master", "group", "region", "curve", "effect")
_TOKEN = "<[^>]*>|[^\\s=<]+=(?:(?!\\s+[^\\s=<]+=)[^<])*"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of every SFZ file under path, one task a file, as a
    line's number is its place in the file."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.[sS][fF][zZ]").select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\\r?\\n")).alias("at", "text")).select("file", F.array(F.col("at").cast("long")).alias("at"), "text")


def included(rows: DataFrame) -> DataFrame:
    """rows with each ``#include`` replaced by the lines of its file: ``at`` is
    the path of line numbers, which orders what is nested."""
    name = F.regexp_extract("text", '^\\s*#include\\s+"?([^"]*?)"?\\s*$', 1)
    folder = F.regexp_replace("file", "[^/]*$", "")
    plain = rows.withColumn("_to", F.when(F.col("text").rlike("^\\s*#include"), F.concat(folder, F.regexp_replace(name, "\\\\", "/"))))
    known = rows.select(F.col("file").alias("_to"), F.col("at").alias("_at"), F.col("text").alias("_text"))
    open_, done = plain.filter("_to is not null"), plain.filter("_to is null").drop("_to")
    for _ in range(MAX_DEPTH):
        if open_.limit(1).count() == 0:
            return done
        got = open_.join(known, "_to").select("file", F.concat("at", "_at").alias("at"), F.col("_text").alias("text"), F.col("_to").alias("_from"))
        deeper = F.regexp_extract("text", '^\\s*#include\\s+"?([^"]*?)"?\\s*$', 1)
        got = got.withColumn("_to", F.when(F.col("text").rlike("^\\s*#include"), F.concat(F.regexp_replace("_from", "[^/]*$", ""), F.regexp_replace(deeper, "\\\\", "/")))).drop("_from")
        done = done.unionByName(got.filter("_to is null").drop("_to"))
        open_ = got.filter("_to is not null")
    raise ValueError("#include is nested too deeply")


def tokens(rows: DataFrame) -> DataFrame:
    """(file, line, header) or (file, line, name, value), in file order."""
    code = F.trim(F.regexp_replace("text", "//.*$", ""))
    found = rows.withColumn("_c", code).filter("_c <> '' and not startswith(_c, '#')")
    each = found.select("file", "at", F.posexplode(F.regexp_extract_all("_c", F.lit(_TOKEN), 0)).alias("n", "t"))
    ordered = each.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at", "n")).cast("long"))
    is_header = F.col("t").startswith("<")
    name = F.lower(F.trim(F.substring_index("t", "=", 1)))
    renamed = F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[name], name)
    value = F.trim(F.expr("substr(t, instr(t, '=') + 1)"))
    return ordered.select("file", "line", F.when(is_header, F.lower(F.trim(F.expr("substr(t, 2, length(t) - 2)")))).alias("header"), F.when(~is_header, renamed).alias("name"), F.when(~is_header, value).alias("value"))


def sections(toks: DataFrame) -> DataFrame:
    """(file, line, header, a column per opcode): a row a section. ``key`` is
    spelled out as its three opcodes before anything is inherited."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = toks.withColumn("_start", F.coalesce(F.last(F.when(F.col("header").isNotNull(), F.col("line")), ignorenulls=True).over(w), F.lit(0).cast("long")))
    value = lambda n: F.max_by("value", F.when(F.col("name") == n, F.col("line")))
    cols = {n: value(n) for n in ["key", "default_path", *OPCODES]}
    got = placed.groupBy("file", F.col("_start").alias("line")).agg(F.coalesce(F.max("header"), F.lit("global")).alias("header"), *[c.alias(n) for n, c in cols.items()])
    spelled = {n: F.coalesce(n, "key") for n in ("lokey", "hikey", "pitch_keycenter")}
    return got.withColumns(spelled).drop("key")


def regions(secs: DataFrame) -> DataFrame:
    """Every region with its inherited opcodes and the default_path of the
    control section before it, in musical units where they have some."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    paths = secs.select("file", "line", F.coalesce(F.last(F.when(F.col("header") == "control", F.col("default_path")), ignorenulls=True).over(w), F.lit("")).alias("default_path"))
    raw = inherit(secs.drop("default_path"), OPCODES).join(paths, ["file", "line"])
    number = lambda n: F.col(n).try_cast("double")
    held = lambda c, lo, hi: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))
    key = lambda n: held(note_number(F.col(n)), 0, 127)
    at_least = lambda n, idle: F.greatest(F.coalesce(number(n), F.lit(idle)), F.lit(0.0))
    group, off = held(F.coalesce(number("group"), F.lit(0.0)).cast("long"), 0, 255), held(number("off_by").cast("long"), 0, 255)
    no_low_pass = F.col("fil_type").isNotNull() & ~F.col("fil_type").startswith("lpf")
    cents = F.when(number("cutoff") > 0, F.log2(number("cutoff") / 8.176) * 1200).otherwise(13500.0)
    return raw.select(
        "file",
        "line",
        F.regexp_replace(F.concat("default_path", "sample"), "\\\\", "/").alias("sample"),
        F.coalesce(key("lokey"), F.lit(0).cast("long")).alias("key_lo"),
        F.coalesce(key("hikey"), F.lit(127).cast("long")).alias("key_hi"),
        key("pitch_keycenter").alias("root_key_override"),
        F.coalesce(held(number("lovel").cast("long"), 0, 127), F.lit(0).cast("long")).alias("vel_lo"),
        F.coalesce(held(number("hivel").cast("long"), 0, 127), F.lit(127).cast("long")).alias("vel_hi"),
        F.round(F.coalesce(number("tune"), F.lit(0.0))).cast("long").alias("fine_tune"),
        held(F.coalesce(number("transpose").cast("long"), F.lit(0)), -127, 127).alias("coarse_tune"),
        held(F.round(F.coalesce(number("pitch_keytrack"), F.lit(100.0))).cast("long"), -1200, 1200).alias("scale_tuning"),
        (F.coalesce(number("volume"), F.lit(0.0)) * -10).alias("attenuation_cb"),
        held(F.coalesce(number("pan"), F.lit(0.0)) / 100, -1.0, 1.0).alias("pan"),
        held(F.coalesce(number("amp_veltrack"), F.lit(100.0)), -100.0, 100.0).alias("amp_veltrack"),
        F.when(F.col("loop_mode") == "loop_continuous", "continuous").when(F.col("loop_mode") == "loop_sustain", "until_release").when(F.col("loop_mode").isin("one_shot", "no_loop"), "none").otherwise("of_sample").alias("loop_mode"),
        F.greatest(F.coalesce(number("offset").cast("long"), F.lit(0).cast("long")), F.lit(0)).alias("addr_start"),
        *[number(n).cast("long").alias(n) for n in ("end", "loop_start", "loop_end")],
        at_least("ampeg_delay", 0.0).alias("delay"),
        at_least("ampeg_attack", 0.001).alias("attack"),
        at_least("ampeg_hold", 0.0).alias("hold"),
        at_least("ampeg_decay", 100.0).alias("decay"),
        held(F.coalesce(number("ampeg_sustain"), F.lit(100.0)) / 100, 0.0, 1.0).alias("sustain"),
        at_least("ampeg_release", 0.05).alias("release"),
        F.when(no_low_pass, 13500.0).otherwise(cents).alias("filter_fc_cents"),
        (F.coalesce(number("resonance"), F.lit(0.0)) * 10).alias("filter_q_cb"),
        F.when(no_low_pass, 0.0).otherwise(held(F.coalesce(number("fil_veltrack"), F.lit(0.0)), -9600.0, 9600.0)).alias("filter_veltrack_cents"),
        F.when((off == group) & (group > 0), group).otherwise(0).alias("exclusive_class"),
    )


def unknown(toks: DataFrame) -> DataFrame:
    """(what, n): headers and opcodes that are not acted on."""
    what = F.when(F.col("header").isNotNull() & ~F.col("header").isin(*HEADERS), F.concat(F.lit("<"), "header", F.lit(">"))).when(F.col("name").isNotNull() & ~F.col("name").isin("key", "default_path", *OPCODES), F.col("name"))
    return toks.select(what.alias("what")).filter("what is not null").groupBy("what").agg(F.count("*").alias("n"))


def cutoff_hz(cents: Column) -> Column:
    return F.exp(cents / 1200 * math.log(2)) * 8.176


def load(spark: SparkSession, path: str) -> DataFrame:
    """The regions of every SFZ file under path."""
    return regions(sections(tokens(included(lines(spark, path)))))


def kind_of(path: str) -> str:
    """Which reader a bank file wants, by its ending."""
    end = os.path.splitext(path)[1].lower()
    if end in (".sf2", ".sf3", ".sfbk"):
        return "soundfont"
    if end == ".sfz":
        return "sfz"
    raise ValueError(f"{path}: unknown kind of bank")
