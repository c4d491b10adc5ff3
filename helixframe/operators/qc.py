"""The ladder of named filters. A rule is a name and a condition; the first that holds names the call's filter, or all are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params

SINGLES = ("SINGLE_LEFT", "SINGLE_RIGHT")
# Fixed values of the rules below.
SUPPORT_OVER_LENGTH = 10
SLOPE, STEP = 0.7, 0.5
DEL_CENTER, DUP_CENTER = 0.33, 0.665
LONGEST_CHECKED = 200_000
SA_SHARE, SA_READS = 0.8, 5
VARIANCE_MAX = 0.3
MOSAIC_READS, MOSAIC_LENGTH, MOSAIC_INVDUP, MOSAIC_STRAND_READS = 3, 50_000, 500, 10
EDGE_SHARE = 0.75


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a), F.col(b))


def coverage_change(svtype: str, p: Params = DEFAULTS, mosaic: bool = False) -> Column:
    """Depth about long deletions (duplications: mirrored) that does not look like one."""
    up, mid, down, size = F.col("cov_upstream"), F.col("cov_center"), F.col("cov_downstream"), F.abs("svlen")
    least = p.long_del_length if svtype == "DEL" else p.long_dup_length
    about = (F.col("svtype") == svtype) & (size >= least) & (size <= LONGEST_CHECKED) & F.lit(not mosaic)
    falling, rising = _ratio("cov_downstream", "cov_upstream"), _ratio("cov_upstream", "cov_downstream")
    slope = ((up > mid) & (mid > down) & (falling < SLOPE)) | ((up < mid) & (mid < down) & (rising < SLOPE))
    if svtype == "DEL":
        off = mid > (up + down) * DEL_CENTER
        sides = ((up > down) & ((falling < STEP) | (mid > down))) | ((up < down) & ((rising < STEP) | (mid > up)))
        return about & ((off & slope) | sides)
    off = mid < (up + down) * DUP_CENTER
    sides = ((up > down) & ((falling < STEP) | (mid < down))) | ((up < down) & ((rising < STEP) | (mid < up)))
    return about & off & (slope | sides)


def rescaled(support: Column, svlen: Column, p: Params = DEFAULTS) -> Column:
    """Support of long insertions, of which reads see less, made larger."""
    return F.bround(support * (1.66 + 0.33 * svlen / p.long_ins_length))


def min_support_auto(regional: Column, overall: Column) -> Column:
    return F.bround(1.5 + 0.1 * (0.75 * regional + 0.25 * overall))


def call_rules(p: Params = DEFAULTS, mosaic: bool = False, max_change: float = -1.0, keep_singles: bool = False, hard_cap: bool = False, strand_bnd: bool = True) -> list[tuple[str, Column]]:
    """Rules before genotyping."""
    c, size = F.col, F.abs("svlen")
    typed = ~c("svtype").isin("BND", *SINGLES)
    rules = [
        ("STDEV_POS", (c("stdev_pos") > p.stdev_pos_max) | (typed & (F.try_divide(c("stdev_pos"), size) > p.stdev_pos_ratio))),
        ("STDEV_LEN", ((c("svtype") != "BND") & (F.try_divide(c("stdev_len"), size) > p.stdev_len_ratio)) | (c("stdev_len") > p.stdev_len_max)),
        ("SINGLE_BREAK", c("svtype").isin(*SINGLES) & F.lit(not keep_singles)),
        ("SVLEN_MIN", (size < p.min_svlen) & (c("svtype") != "BND") & ((c("support") < SUPPORT_OVER_LENGTH) | F.lit(hard_cap))),
        ("STRAND_BND", (c("svtype") == "BND") & F.lit(strand_bnd) & ((c("fwd") == 0) | (c("rev") == 0))),
        ("COV_CHANGE_DEL", coverage_change("DEL", p, mosaic)),
        ("COV_CHANGE_DUP", coverage_change("DUP", p, mosaic)),
        ("COV_CHANGE_INS", (c("svtype") == "INS") & ((c("cov_upstream") < p.coverage_min) | (c("cov_downstream") < p.coverage_min))),
        ("INLINE_SA", c("svtype").isin("INS", "DEL") & (c("sa_share") > SA_SHARE) & (c("sa_count") > SA_READS) & (F.coalesce("support_sa", F.lit(0)) == 0)),
        ("COV_VAR", c("coverage_var") >= VARIANCE_MAX),
    ]
    if max_change != -1.0:
        at = [F.when(c(f"cov_{x}") != 0, c(f"cov_{x}")).otherwise(1) for x in ("upstream", "start", "center", "end", "downstream")]
        rules += [(f"COV_CHANGE_FRAC_{n}", F.abs(a - b) / F.greatest(a, b) > max_change) for n, a, b in zip(("US", "SC", "CE", "ED"), at, at[1:])]
    return rules


def support_rule(p: Params = DEFAULTS, auto: bool = False) -> list[tuple[str, Column]]:
    """The fixed least support, or the one that follows depth (cov_center regional, cov_global overall)."""
    if not auto:
        return [("SUPPORT_MIN", F.col("support") < p.min_support)]
    long_ins = (F.col("svtype") == "INS") & (F.col("svlen") >= p.long_ins_length)
    support = F.when(long_ins, rescaled(F.col("support"), F.col("svlen"), p)).otherwise(F.col("support"))
    return [("SUPPORT_MIN", support < min_support_auto(F.col("cov_center"), F.col("cov_global")))]


def genotype_rules(p: Params = DEFAULTS, mosaic: bool = False, strand: bool = False, nm: bool = False, include_germline: bool = False) -> list[tuple[str, Column]]:
    """Rules after genotyping; gt_a and gt_b are null without a genotype, vaf may be null."""
    c, size = F.col, F.abs("svlen")
    vaf = F.coalesce("vaf", F.lit(0.0))
    low = vaf <= p.mosaic_af_max
    mosaic_call = low & F.lit(mosaic)
    typed = ~c("svtype").isin("BND", *SINGLES)
    one_strand = (c("fwd") == 0) | (c("rev") == 0)
    short = ~((c("svtype") == "INS") & (c("svlen") >= p.long_ins_length))
    loose = ~c("precise") | (F.try_divide(c("stdev_len"), size) > 0.1) | (c("stdev_pos") > 5)
    least = F.when(c("svtype").isin("BND", "INV") | loose | c("stdev_len").isNull(), MOSAIC_READS).otherwise(MOSAIC_READS - 1)
    return [
        ("COV_MIN_GT", (c("cov_center") < p.coverage_min) & (c("gt_a").isNull() | (c("gt_a") + c("gt_b") < 2)) & (c("svtype") != "DEL") & (size > p.long_del_length)),
        ("ALN_NM", F.lit(nm or mosaic) & (F.lit(nm) | mosaic_call) & (c("nm") > c("regional_nm") * p.nm_factor) & (F.coalesce("gt_b", F.lit(0)) == 0)),
        ("MOSAIC_VAF", F.lit(not mosaic) & low & ~((c("svtype") == "DUP") & (vaf >= p.dup_min_vaf))),
        ("SUPPORT_MIN", mosaic_call & (c("support") < least)),
        ("SVLEN_MAX_MOSAIC", mosaic_call & (c("svtype") != "BND") & (size > MOSAIC_LENGTH)),
        ("STRAND", F.lit(strand) & ~mosaic_call & (c("svtype") != "BND") & short & one_strand),
        ("STRAND_MOSAIC", mosaic_call & (c("svtype") != "BND") & short & one_strand & (c("support") >= MOSAIC_STRAND_READS)),
        ("SVLEN_MIN_MOSAIC", mosaic_call & c("svtype").isin("INV", "DUP") & (c("svlen") < MOSAIC_INVDUP)),
        ("COV_MIN", (c("cov_center") < p.coverage_min) & ~c("svtype").isin("DEL", "INS") & ~((c("svtype") == "INV") & (c("svlen") > p.long_inv_length) & ~mosaic_call)),
        ("MOSAIC_VAF", mosaic_call & ((vaf < p.mosaic_af_min) | (vaf > p.mosaic_af_max))),
        ("NOT_MOSAIC_VAF", F.lit(mosaic and not include_germline) & ~low),
        ("MOSAIC_SV_CLOSE_EDGE", mosaic_call & typed & (F.try_divide(c("edge_reads"), c("support")) >= EDGE_SHARE)),
    ]


def first_filter(rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in rules), F.lit("PASS"))


def all_filters(rules: list[tuple[str, Column]]) -> Column:
    hit = F.array_distinct(F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules))))
    return F.when(F.size(hit) == 0, "PASS").otherwise(F.array_join(hit, ";"))


def emitted(calls: DataFrame, p: Params = DEFAULTS, n_share: float = 0.5) -> DataFrame:
    """Calls that are written: no single breaks, no call that no sample has, no short insertions, no deletion that is mostly N."""
    ref_n = F.length("ref") - F.length(F.replace("ref", F.lit("N"), F.lit("")))
    keep = ~F.col("svtype").isin(*SINGLES) & ~F.coalesce(~F.contains("supp_vec", F.lit("1")), F.lit(False))
    keep &= ~((F.col("svtype") == "INS") & ~F.col("alt").startswith("<") & (F.length("alt") < p.min_svlen))
    keep &= ~((F.col("svtype") == "DEL") & (F.try_divide(ref_n, F.length("ref")) > n_share))
    return calls.where(keep)
