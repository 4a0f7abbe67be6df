"""SoundFont 2 files as tables.

`records` reads each file's record chunks with Spark's binaryFile; the tables
made from it (`zones`, `regions`, `samples`) are joins, windows and
projections. A zone's records run from its bag's index to the next one's
(``lead``), the last record of each chunk only ending the one before.

Defined cases: what isn't RIFF/sfbk fails; a chunk is cut at its list's end; a
zone without key or velocity range covers all; a first zone without an
instrument (or sample) is global and gives defaults to its siblings; swapped
ranges are put in order.

Records compress to far less than their rows take in memory, so Spark's estimate
of a table's size says little: joins are marked as merged, never broadcast.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import centibels_to_gain, timecents_to_seconds
from ..operators.zones import intersect, layered

# Record layouts, and the generators that are read.
LAYOUTS = {
    "phdr": np.dtype([("name", "S20"), ("program", "<u2"), ("bank", "<u2"), ("bag", "<u2"), ("rest", "V12")]),
    "pbag": np.dtype([("gen", "<u2"), ("mod", "<u2")]),
    "pgen": np.dtype([("op", "<u2"), ("amount", "<i2")]),
    "inst": np.dtype([("name", "S20"), ("bag", "<u2")]),
    "ibag": np.dtype([("gen", "<u2"), ("mod", "<u2")]),
    "igen": np.dtype([("op", "<u2"), ("amount", "<i2")]),
    "shdr": np.dtype([("name", "S20"), ("start", "<u4"), ("end", "<u4"), ("loop_start", "<u4"), ("loop_end", "<u4"), ("rate", "<u4"), ("root", "u1"), ("correction", "i1"), ("link", "<u2"), ("kind", "<u2")]),
}
GENERATORS = {
    "start": 0, "end": 1, "loop_start": 2, "loop_end": 3, "start_coarse": 4, "filter_fc": 8, "filter_q": 9, "end_coarse": 12, "pan": 17,
    "delay": 33, "attack": 34, "hold": 35, "decay": 36, "sustain": 37, "release": 38, "key_to_hold": 39, "key_to_decay": 40,
    "instrument": 41, "key_range": 43, "vel_range": 44, "loop_start_coarse": 45, "fixed_key": 46, "fixed_vel": 47, "attenuation": 48,
    "loop_end_coarse": 50, "coarse_tune": 51, "fine_tune": 52, "sample": 53, "modes": 54, "scale_tuning": 56, "exclusive": 57, "root_key": 58,
}
DEFAULTS = {"filter_fc": 13500, "delay": -12000, "attack": -12000, "hold": -12000, "decay": -12000, "release": -12000, "scale_tuning": 100, "root_key": -1, "fixed_key": -1, "fixed_vel": -1}
#: Only an instrument's zones may set these; a preset's are passed over.
ABSOLUTE = ("start", "end", "loop_start", "loop_end", "start_coarse", "end_coarse", "loop_start_coarse", "loop_end_coarse", "fixed_key", "fixed_vel", "modes", "exclusive", "root_key")
RECORD = "path string, chunk string, idx int, name string, a long, b long, c long, values array<long>"


def chunks(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(tag, offset, size) of the chunks inside the sdta and pdta lists."""
    if data[:4] != b"RIFF" or data[8:12] != b"sfbk":
        raise ValueError("not a SoundFont")
    at = 12
    while at + 8 <= len(data):
        size = min(struct.unpack_from("<I", data, at + 4)[0], len(data) - at - 8)
        if data[at : at + 4] == b"LIST" and data[at + 8 : at + 12] in (b"sdta", b"pdta"):
            inner, end = at + 12, at + 8 + size
            while inner + 8 <= end:
                n = min(struct.unpack_from("<I", data, inner + 4)[0], end - inner - 8)
                yield data[inner : inner + 4].decode("latin-1"), inner + 8, n
                inner += 8 + n + (n & 1)
        at += 8 + size + (size & 1)


def records_of(data: bytes) -> Iterator[tuple]:
    """(chunk, idx, name, a, b, c, values) of every record."""
    for tag, at, size in chunks(data):
        if tag == "smpl":
            yield tag, 0, None, at, size // 2, None, None
        if tag not in LAYOUTS:
            continue
        rows = np.frombuffer(data, LAYOUTS[tag], size // LAYOUTS[tag].itemsize, at)
        for i, r in enumerate(rows):
            name = r["name"].split(b"\0")[0].decode("utf-8", "replace").strip() if "name" in LAYOUTS[tag].names else None
            if tag == "phdr":
                yield tag, i, name, int(r["bag"]), int(r["bank"]), int(r["program"]), None
            elif tag == "inst":
                yield tag, i, name, int(r["bag"]), None, None, None
            elif tag == "shdr":
                yield tag, i, name, None, None, None, [int(r[k]) for k in ("start", "end", "loop_start", "loop_end", "rate", "root", "correction", "kind")]
            else:
                yield tag, i, None, int(r[0]), int(r[1]), None, None


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, chunk, idx, name, a, b, c, values) of all files under path. In
    phdr, a, b, c are bag, bank, program; in bags a is the first generator; in
    generators a, b are op and amount; smpl's a, b are offset and frames."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                out = pd.DataFrame([(p, *r) for r in records_of(bytes(data))], columns=names)
                yield out.astype({"a": "Int64", "b": "Int64", "c": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][fF]*").load(path)
    return files.select("path", "content").mapInPandas(parse, RECORD)


def _generators(recs: DataFrame, head: str, bag: str, gen: str, target: str) -> DataFrame:
    """(path, owner, zone, g): the zones of presets or instruments with their
    generators as a map by number, and whether the zone is global."""
    w = Window.partitionBy("path").orderBy("idx")
    owners = recs.filter(F.col("chunk") == head).select("path", F.col("idx").alias("owner"), F.col("a").alias("from"), F.lead("a").over(w).alias("to")).filter("to is not null")
    bags = recs.filter(F.col("chunk") == bag).select("path", F.col("idx").alias("zone"), F.col("a").alias("first"), F.lead("a").over(w).alias("end")).filter("end is not null")
    gens = recs.filter(F.col("chunk") == gen).select("path", F.col("idx").cast("long").alias("i"), F.col("a").alias("op"), F.col("b").alias("amount"))
    # A zone's numbers are spelled out, so that both joins are equal ones.
    owned = owners.select("path", "owner", F.explode(F.expr("if(to > from, sequence(from, to - 1), array())")).alias("zone"))
    spelled = bags.select("path", "zone", F.explode_outer(F.expr("if(end > first, sequence(first, end - 1), cast(array() as array<bigint>))")).alias("i"))
    # The last of equal generators counts.
    found = spelled.join(gens.hint("merge"), ["path", "i"], "left").groupBy("path", "zone", "op").agg(F.max_by("amount", "i").alias("amount"))
    maps = found.groupBy("path", "zone").agg(F.map_from_entries(F.collect_list(F.when(F.col("op").isNotNull(), F.struct("op", "amount")))).alias("g"))
    first = F.min("zone").over(Window.partitionBy("path", "owner"))
    zones = owned.join(maps.hint("merge"), ["path", "zone"]).withColumn("_first", first)
    aim = F.col("g")[F.lit(GENERATORS[target]).cast("long")]
    return zones.withColumns({"target": aim, "is_global": aim.isNull() & (F.col("zone") == F.col("_first"))}).drop("_first")


def _value(g: str, name: str) -> Column:
    return F.col(g)[F.lit(GENERATORS[name]).cast("long")]


def _ranges(g: str, common: str, name: str) -> tuple[Column, Column]:
    both = F.coalesce(_value(g, name), _value(common, name), F.lit(127 << 8).cast("long"))
    return both.bitwiseAND(127), F.shiftright(both, 8).bitwiseAND(127)


def _with_global(zones: DataFrame, prefix: str) -> DataFrame:
    common = zones.filter("is_global").select("path", "owner", F.col("g").alias(f"{prefix}_global"))
    own = zones.filter("not is_global and target is not null").select("path", "owner", F.col("zone").alias(f"{prefix}_zone"), F.col("g").alias(f"{prefix}_g"), F.col("target").alias(f"{prefix}_target"))
    return own.join(common.hint("merge"), ["path", "owner"], "left").withColumnRenamed("owner", f"{prefix}_owner")


def regions(recs: DataFrame) -> DataFrame:
    """Every preset zone with every zone of its instrument whose ranges meet:
    instrument values over their global zone's over defaults, plus a preset's
    offsets, in musical units."""
    presets = _with_global(_generators(recs, "phdr", "pbag", "pgen", "instrument"), "p")
    instruments = _with_global(_generators(recs, "inst", "ibag", "igen", "sample"), "i")
    both = presets.join(instruments.withColumnRenamed("i_owner", "p_target").hint("merge"), ["path", "p_target"])
    k = intersect(*_ranges("p_g", "p_global", "key_range"), *_ranges("i_g", "i_global", "key_range"))
    v = intersect(*_ranges("p_g", "p_global", "vel_range"), *_ranges("i_g", "i_global", "vel_range"))

    def merged(name: str) -> Column:
        offset = F.lit(0) if name in ABSOLUTE else F.coalesce(_value("p_g", name), _value("p_global", name))
        return layered(F.lit(DEFAULTS.get(name, 0)), [_value("i_global", name), _value("i_g", name)], offset)

    seconds = lambda name: timecents_to_seconds(merged(name))
    far = lambda name: merged(name) + merged(f"{name}_coarse") * 32768
    mode = merged("modes").bitwiseAND(3)
    heads = recs.filter("chunk = 'phdr'").select("path", F.col("idx").alias("p_owner"), F.col("name").alias("preset_name"), F.col("b").alias("bank"), F.col("c").alias("program"))
    return both.join(heads.hint("merge"), ["path", "p_owner"]).select(
        "path",
        F.col("p_owner").alias("preset"),
        "preset_name",
        "bank",
        "program",
        "p_zone",
        "i_zone",
        F.col("i_target").alias("sample"),
        k[0].alias("key_lo"),
        k[1].alias("key_hi"),
        v[0].alias("vel_lo"),
        v[1].alias("vel_hi"),
        merged("root_key").alias("root_key_override"),
        merged("fixed_key").alias("fixed_key"),
        merged("fixed_vel").alias("fixed_vel"),
        merged("coarse_tune").alias("coarse_tune"),
        merged("fine_tune").alias("fine_tune"),
        merged("scale_tuning").alias("scale_tuning"),
        merged("attenuation").cast("double").alias("attenuation_cb"),
        F.least(F.greatest(merged("pan") / 500, F.lit(-1.0)), F.lit(1.0)).alias("pan"),
        F.when(mode == 1, "continuous").when(mode == 3, "until_release").otherwise("none").alias("loop_mode"),
        far("start").alias("addr_start"),
        far("end").alias("addr_end"),
        far("loop_start").alias("addr_loop_start"),
        far("loop_end").alias("addr_loop_end"),
        *[seconds(n).alias(n) for n in ("delay", "attack", "hold", "decay", "release")],
        centibels_to_gain(F.greatest(merged("sustain"), F.lit(0))).alias("sustain"),
        merged("key_to_hold").alias("keynum_to_hold"),
        merged("key_to_decay").alias("keynum_to_decay"),
        merged("filter_fc").cast("double").alias("filter_fc_cents"),
        merged("filter_q").cast("double").alias("filter_q_cb"),
        F.least(F.greatest(merged("exclusive"), F.lit(0)), F.lit(255)).alias("exclusive_class"),
    ).filter("key_lo <= key_hi and vel_lo <= vel_hi")


def samples(recs: DataFrame) -> DataFrame:
    """(path, sample, name, start, end, loop_start, loop_end, rate, root_key,
    correction_cents) without the terminal record."""
    last = F.max("idx").over(Window.partitionBy("path"))
    rows = recs.filter("chunk = 'shdr'").withColumn("_last", last).filter("idx < _last")
    names = ("start", "end", "loop_start", "loop_end", "rate", "root_key", "correction_cents")
    return rows.select("path", F.col("idx").cast("long").alias("sample"), "name", *[F.col("values")[i].alias(n) for i, n in enumerate(names)])


def used_samples(recs: DataFrame) -> DataFrame:
    """The samples that a region refers to."""
    return samples(recs).join(regions(recs).select("path", "sample").distinct().hint("merge"), ["path", "sample"], "left_semi")


def fetch(recs: DataFrame) -> DataFrame:
    """(path, sample, pcm): frames of the used samples only; each is a ranged
    read of its file by the task that needs it."""
    smpl = recs.filter("chunk = 'smpl'").select("path", F.col("a").alias("base"), F.col("b").alias("frames"))
    wanted = used_samples(recs).join(smpl.hint("merge"), "path").select("path", "sample", "base", F.least("start", "frames").alias("start"), F.least("end", "frames").alias("end"))

    def pull(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                with open(r.path.removeprefix("file:"), "rb") as f:
                    f.seek(r.base + 2 * r.start)
                    out.append(np.frombuffer(f.read(2 * max(r.end - r.start, 0)), "<i2"))
            yield pd.DataFrame({"path": b["path"], "sample": b["sample"], "pcm": out})

    return wanted.mapInPandas(pull, "path string, sample long, pcm array<smallint>")


def write_file(path: str, presets: list[tuple], instruments: list[tuple], sample_rows: list[tuple], pcm: np.ndarray) -> None:
    """A small SoundFont: presets (name, bank, program, zones), instruments
    (name, zones), where a zone is a list of (generator name, amount), and
    samples as the fields of shdr. A range is lo + 256 * hi."""

    def chunk(tag: str, body: bytes) -> bytes:
        return tag.encode() + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    def zones(owners: list) -> tuple[bytes, bytes, list[int]]:
        bag, gen, starts = [], [], []
        for own in owners:
            starts.append(len(bag))
            for z in own:
                bag.append((len(gen), 0))
                gen += [(GENERATORS[n], a) for n, a in z]
        return np.array([*bag, (len(gen), 0)], LAYOUTS["pbag"]).tobytes(), np.array([*gen, (0, 0)], LAYOUTS["pgen"]).tobytes(), [*starts, len(bag)]

    pbag, pgen, pat = zones([p[3] for p in presets])
    ibag, igen, iat = zones([i[1] for i in instruments])
    phdr = np.array([(n, prog, bank, at, b"") for (n, bank, prog, _), at in zip([*presets, ("EOP", 0, 0, [])], pat, strict=True)], LAYOUTS["phdr"])
    inst = np.array([(n, at) for (n, _), at in zip([*instruments, ("EOI", [])], iat, strict=True)], LAYOUTS["inst"])
    shdr = np.array([*sample_rows, ("EOS", 0, 0, 0, 0, 0, 0, 0, 0, 0)], LAYOUTS["shdr"])
    sdta = b"sdta" + chunk("smpl", pcm.astype("<i2").tobytes())
    pdta = b"pdta" + b"".join(chunk(t, b) for t, b in (("phdr", phdr.tobytes()), ("pbag", pbag), ("pmod", b"\0" * 10), ("pgen", pgen), ("inst", inst.tobytes()), ("ibag", ibag), ("imod", b"\0" * 10), ("igen", igen), ("shdr", shdr.tobytes())))
    body = b"sfbk" + chunk("LIST", sdta) + chunk("LIST", pdta)
    with open(path, "wb") as f:
        f.write(chunk("RIFF", body))
