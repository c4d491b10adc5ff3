"""Sources. Text formats are read by spark.read.text and parsed by expressions; malformed optional lines are dropped, as each says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, STORE_VERSION, Params
from ..functions.intervals import binned
from ..operators.scan import cigar_ops, total
from . import blocked_gzip
from .sequences import fasta, fasta_index  # noqa: F401


def bed_regions(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end) of a BED file; comments, blank and malformed lines are left out."""
    return parse_bed(spark.read.text(path))


def parse_bed(lines: DataFrame) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    x = lines.where(~F.ltrim("value").startswith("#")).select(F.get(f, F.lit(0)).alias("contig"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"))
    return x.where("contig <> '' and start is not null and end is not null")


def region_strings(spark: SparkSession, regions: list[str]) -> DataFrame:
    """(contig, start, end) of contig:start-stop strings."""
    x = spark.createDataFrame([(r,) for r in regions], "value string")
    part = lambda i: F.regexp_extract("value", r"^(.+):(\d+)-(\d+)$", i)
    return x.select(part(1).alias("contig"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end")).where("start is not null")


def tandem_repeats(spark: SparkSession, path: str, p: Params = DEFAULTS) -> DataFrame:
    """(contig, start, end) of a BED file, padded on both sides, starts at 0 at least."""
    x = parse_bed(spark.read.text(path))
    return x.select("contig", F.greatest(F.col("start") - p.repeat_padding, F.lit(0)).alias("start"), (F.col("end") + p.repeat_padding).alias("end"))


def bases(points: DataFrame, reference: DataFrame, chunk: int, out: str = "base") -> DataFrame:
    """``points`` (contig, at, ...) with the base at ``at`` (from 0), null off the reference: an equi-join on chunks."""
    x = points.withColumn("chunk_no", F.floor(F.col("at") / chunk).cast("int")).join(reference, ["contig", "chunk_no"], "left")
    base = F.substring("seq", F.pmod("at", F.lit(chunk)) + 1, F.lit(1))
    return x.select(*points.columns, F.when(base != "", base).alias(out))


def sequences(spans: DataFrame, reference: DataFrame, chunk: int, key: str, out: str = "bases") -> DataFrame:
    """(``key``, bases) of ``spans`` (key, contig, start, end): what ``reference`` has of [start, end), by an equi-join on chunks. Spans are short, so their pieces are few."""
    cut = binned(spans.where("start < end"), F.col("start"), F.col("end") - 1, chunk, "chunk_no").withColumn("chunk_no", F.col("chunk_no").cast("int"))
    x = cut.join(reference, ["contig", "chunk_no"])
    low = F.greatest(F.col("start") - F.col("chunk_no").cast("long") * chunk, F.lit(0))
    high = F.least(F.col("end") - F.col("chunk_no").cast("long") * chunk, F.lit(chunk))
    piece = F.struct("chunk_no", F.substring(F.col("seq"), (low + 1).cast("int"), (high - low).cast("int")).alias("piece"))
    return x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda c: c["piece"]), "").alias(out))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, in file order by aln_idx; header lines and unmapped reads are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    x = lines.withColumn("aln_idx", F.monotonically_increasing_id()).where(F.size(f) >= 11)
    x = x.select("aln_idx", f[0].alias("read_qname"), f[1].cast("int").alias("flag"), f[2].alias("contig"), (f[3].cast("long") - 1).alias("ref_start"), f[4].cast("int").alias("mapq"), f[5].alias("cigar"), f[9].alias("seq"), *(F.try_element_at(F.filter(F.slice(f, 12, 1000), lambda t: t.startswith(f"{n}:")), F.lit(1)).alias(f"_{n}") for n in ("SA", "HP", "PS", "NM")))
    value = lambda n: F.substring(F.col(f"_{n}"), 6, F.length(f"_{n}"))
    ops = cigar_ops(F.col("cigar"))
    first, last = F.get(ops, F.lit(0)), F.element_at(ops, -1)
    soft = lambda o: F.when(o["op"] == "S", o["len"]).otherwise(0)
    length = total(ops, "MIS=X")
    x = x.where("contig <> '*' and cigar <> '*'").withColumns({"sa": value("SA"), "hp": value("HP").try_cast("int"), "ps": value("PS"), "nm": value("NM").try_cast("int"), "ref_end": F.col("ref_start") + total(ops, "MDN=X"), "query_length": length, "qry_start": soft(first), "qry_end": length - F.when(F.size(ops) > 1, soft(last)).otherwise(0)})
    return x.drop("_SA", "_HP", "_PS", "_NM")


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length, contig_idx) of the @SQ lines, in file order."""
    x = spark.read.text(path).where(F.col("value").startswith("@SQ")).withColumn("contig_idx", F.monotonically_increasing_id())
    return x.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"), "contig_idx")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF (plain, gzip or blocked gzip), see ``parse_vcf``; line_index keeps the file's order. A blocked file is read by many tasks, a plain gzip one by one."""
    if path.endswith((".gz", ".bgz")) and not any(c in path for c in "*?{[") and blocked_gzip.is_blocked(path):
        lines = blocked_gzip.lines(spark, path)
    else:
        lines = spark.read.text(path).withColumn("line_index", F.monotonically_increasing_id())
    return parse_vcf(lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """(line_index, contig, pos from 0, id, ref, alt, svtype, svlen, end, mate_contig, mate_pos, info map, line). Types and lengths that INFO lacks come from REF and ALT. A line of fewer than 8 columns raises."""
    f = F.split("value", "\t")
    checked = F.when(F.size(f) >= 8, f).otherwise(F.raise_error(F.concat(F.lit("malformed VCF line: "), "value")).cast("array<string>"))
    pairs = F.transform(F.split("_info", ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x))).otherwise("True").alias("v")))
    x = lines.withColumn("_f", checked).select("line_index", F.col("_f")[0].alias("contig"), (F.col("_f")[1].cast("long") - 1).alias("pos"), F.col("_f")[2].alias("id"), F.col("_f")[3].alias("ref"), F.col("_f")[4].alias("alt"), F.col("_f")[7].alias("_info"), F.col("value").alias("line"))
    # the last value of a key counts
    x = x.withColumn("info", F.map_from_entries(_last_of_keys(pairs))).drop("_info")
    sized = F.length("alt") - F.length("ref")
    symbol = F.regexp_extract("alt", r"^<([A-Z]+)", 1)
    mate = F.regexp_extract("alt", r"[\[\]](.+):(\d+)[\[\]]", 1)
    kind = F.coalesce(F.col("info")["SVTYPE"], F.when(mate != "", "BND").when(symbol != "", symbol).when(sized >= 0, "INS").otherwise("DEL"))
    kind = F.when(kind == "TRA", "BND").otherwise(kind)
    size = F.coalesce(F.col("info")["SVLEN"].try_cast("long"), F.when((symbol == "") & (mate == ""), sized).otherwise(0).cast("long"))
    size = F.when((kind == "DEL") & (size > 0), -size).otherwise(size)
    end = F.coalesce(F.col("info")["END"].try_cast("long"), F.when(kind == "INS", F.col("pos")).otherwise(F.col("pos") + F.abs(size)))
    return x.select("line_index", "contig", "pos", "id", "ref", "alt", kind.alias("svtype"), size.alias("svlen"), end.alias("end"), F.nullif(mate, F.lit("")).alias("mate_contig"), F.regexp_extract("alt", r"[\[\]](.+):(\d+)[\[\]]", 2).try_cast("long").alias("mate_pos"), "info", "line")


def _last_of_keys(pairs):
    return F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, e: F.array_append(F.filter(a, lambda o: o["k"] != e["k"]), F.struct(e["k"].alias("k"), e["v"].alias("v"))))


def store(spark: SparkSession, path: str, contig: str | None = None, block: int | None = None) -> DataFrame:
    """Candidates of a block store; contig prunes folders, block prunes row groups."""
    x = spark.read.parquet(path)
    x = x.where(F.col("contig") == contig) if contig is not None else x
    return x.where(F.col("block") == block) if block is not None else x


def store_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_id) of a list of stores; comments are left out; more than two columns raise; without an id it is the path's stem."""
    f = F.split("value", "\t")
    x = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    checked = F.when(F.size(f) <= 2, f).otherwise(F.raise_error(F.concat(F.lit("too many columns: "), "value")).cast("array<string>"))
    stem = F.regexp_replace(F.element_at(F.split(F.col("path"), "/"), -1), r"\.[^.]*$", "")
    return x.select(checked[0].alias("path"), F.get(checked, F.lit(1)).alias("own")).select("path", F.coalesce(F.nullif("own", F.lit("")), stem).alias("sample_id"))


def store_headers(spark: SparkSession, paths: list[str], names: dict[str, str] | None = None, p: Params = DEFAULTS) -> DataFrame:
    """(root, sample_id, version) of the stores at ``paths``: ids as ``names`` has them by path, else as the header does, else the path's stem; repeated ids raise. Other block or bin sizes, and newer versions, raise."""
    schema = "sample_id string, version string, block_size long, coverage_bin long"
    rows = spark.read.schema(schema).json([f"{x}/header" for x in paths])
    rows = rows.select(F.substring_index("_metadata.file_path", "/header/", 1).alias("root"), "*").collect()  # one for each store
    if len(rows) != len(set(paths)):
        raise ValueError(f"{len(set(paths))} stores have {len(rows)} headers")
    named = {_whole_path(spark, k): v for k, v in (names or {}).items()}
    out, numbers = [], lambda v: [int(x) if x.isdigit() else 0 for x in (v or "").split(".")]
    for r in rows:
        if (r["block_size"], r["coverage_bin"]) != (p.block_size, p.coverage_bin):
            raise ValueError(f"{r['root']}: blocks of {r['block_size']} and bins of {r['coverage_bin']} bases, not {p.block_size} and {p.coverage_bin}")
        if numbers(r["version"])[:1] > numbers(STORE_VERSION)[:1]:
            raise ValueError(f"{r['root']}: version {r['version']} is newer than {STORE_VERSION}")
        own = named.get(_whole_path(spark, r["root"], encoded=True))
        out.append((r["root"], own or r["sample_id"] or r["root"].rpartition("/")[2].split(".")[0], r["version"]))
    ids = [x[1] for x in out]
    if repeated := sorted({x for x in ids if ids.count(x) > 1}):
        raise ValueError(f"several stores are of one sample id: {', '.join(repeated)}")
    return spark.createDataFrame(out, "root string, sample_id string, version string")


def _whole_path(spark: SparkSession, path: str, encoded: bool = False) -> str:
    """The path with its store and from its root on; ``encoded``: as an address, as Spark names a row's file."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    at = of(spark._jvm.java.net.URI(path)) if encoded else of(path.rstrip("/"))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def sample_stores(spark: SparkSession, paths: list[str], names: dict[str, str] | None = None, contig: str | None = None, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, binned depth and samples (root, sample_id, version) of any number of stores, each in one read."""
    samples = store_headers(spark, paths, names, p)

    def part(kind: str) -> DataFrame:
        x = spark.read.parquet(*[f"{x}/{kind}" for x in paths]).drop("sample_id").withColumn("root", F.substring_index("_metadata.file_path", f"/{kind}/", 1))
        x = x.where(F.col("contig") == contig) if contig is not None else x
        return x.join(F.broadcast(samples), "root").drop("root")

    return part("candidates"), part("coverage").drop("version"), samples


def population(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    """Variants with their frequencies; contig prunes folders."""
    x = spark.read.parquet(path)
    return x.where(F.col("contig") == contig) if contig is not None else x
