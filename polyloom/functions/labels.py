"""Classifications as column expressions: first matching rule wins. Thresholds are arguments; the defaults are the published rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyloom.functions import wording


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(text: str, **values) -> Column:
    """The text with names in braces replaced by columns or strings."""
    parts = re.split(r"\{(\w+)\}", text)
    out = [F.lit(x) if i % 2 == 0 else values[x].cast("string") if isinstance(values[x], Column) else F.lit(str(values[x])) for i, x in enumerate(parts)]
    return F.concat(*out) if len(out) > 1 else out[0]


def site_status(raw: str | Column, known: str | Column, override: dict[str, str] | None = None) -> Column:
    """Site of a raw population code, and how it was found. ``known``: array of known sites. struct(site, status).

    Empty: Unassigned. An override: Inferred. Digits of a known site: Assigned. Digits before the first ``-`` of a known site: Inferred.
    """
    raw, known = F.trim(_col(raw)), _col(known)
    made = lambda digits: F.concat(F.lit("EO"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    row = lambda site, status: F.struct(site.alias("site"), F.lit(status).alias("status"))
    nothing = row(F.lit(None).cast("string"), "Unassigned")
    prefix = F.regexp_extract(raw, r"^(\d+)-", 1)
    out = F.when(raw.isNull() | (raw == ""), nothing)
    for code, site in (override if override is not None else {"15": "EO18"}).items():
        out = out.when(raw == code, row(F.lit(site), "Inferred"))
    out = out.when(raw.rlike(r"^\d+$") & F.array_contains(known, made(raw)), row(made(raw), "Assigned"))
    return out.when((prefix != "") & F.array_contains(known, made(prefix)), row(made(prefix), "Inferred")).otherwise(nothing)


def naive_site(raw: str | Column) -> Column:
    """The site of a code without a list of known ones: leading digits as they are."""
    digits = F.regexp_extract(F.trim(_col(raw)), r"^(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("EO"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)))


def pooled(code: str | Column, pools: dict[str, str] | None = None) -> Column:
    """Sub-codes of one site pooled."""
    pools = {"27pv": "27", "27rt": "27"} if pools is None else pools
    code = _col(code)
    out = code
    for a, b in pools.items():
        out = F.when(code == a, F.lit(b)).otherwise(out)
    return out


def individual_id(sequence_id: str | Column, tokens: int = 2) -> Column:
    return F.substring_index(_col(sequence_id), "_", tokens)


def individual_class(total, functional, alleles, dropped, rate, most: int = 4, least_rate: float = 0.5) -> Column:
    """State of an individual after translation; ``dropped``: whether the abundance filter took all it had."""
    total, functional, alleles, dropped, rate = map(_col, (total, functional, alleles, dropped, rate))
    return (
        F.when(total == 0, "no_sequences")
        .when(functional == 0, "no_functional_proteins")
        .when(alleles > most, "too_many_alleles")
        .when(dropped, "dropped_abundance_filter")
        .when(rate < least_rate, "low_functional_rate")
        .otherwise("normal")
    )


def genotype_class(counts: str | Column) -> Column:
    """AAAA, AAAB, AABB, AABC or ABCD from the array of copy counts by allele (any order); two alleles are AAAB where one has twice the copies of the other."""
    c = F.sort_array(_col(counts), asc=False)
    n = F.size(c)
    return F.when(n <= 0, "Unknown").when(n == 1, "AAAA").when(n == 2, F.when(F.get(c, F.lit(0)) >= 2 * F.get(c, F.lit(1)), "AAAB").otherwise("AABB")).when(n == 3, "AABC").otherwise("ABCD")


def zygosity(alleles: str | Column) -> Column:
    return F.when(_col(alleles) == 1, "Homozygous").otherwise("Heterozygous")


def class_score(genotype: str | Column) -> Column:
    """Share of gametes with two different alleles; null for Unknown."""
    g = _col(genotype)
    return F.when(g == "ABCD", 1.0).when(g == "AABC", 5 / 6).when(g == "AABB", 4 / 6).when(g == "AAAB", 3 / 6).when(g == "AAAA", 0.0)


def score_class(score: str | Column) -> Column:
    """The class of a score by cut points half-way; null counts as AAAA."""
    s = _col(score)
    return F.when(s >= 0.917, "ABCD").when(s >= 0.750, "AABC").when(s >= 0.583, "AABB").when(s >= 0.250, "AAAB").otherwise("AAAA")


def score_tier(score: str | Column) -> Column:
    """Named tiers closed on the left at .001, .501, .668, .751, .834."""
    s, t = _col(score), wording.TIERS
    return F.when(s < 0.001, t[0]).when(s < 0.501, t[1]).when(s < 0.668, t[2]).when(s < 0.751, t[3]).when(s < 0.834, t[4]).when(s.isNotNull(), t[5])


def group_status(mean_score, share_aaaa, low: float = 0.667, high: float = 0.30) -> Column:
    """CRITICAL, AT RISK or OK, on values rounded to three places as they are reported."""
    weak, fixed = F.round(_col(mean_score), 3) < low, F.round(_col(share_aaaa), 3) > high
    return F.when(weak & fixed, "CRITICAL").when(weak | fixed, "AT RISK").otherwise("OK")


def conservation_quadrant(depletion, compatibility, deep: float = 0.5, fit: float = 0.4) -> Column:
    """The strategy of a group; null where either value is."""
    d, p = _col(depletion) >= deep, _col(compatibility) >= fit
    healthy, preventive, skew, urgent = wording.STRATEGIES
    return F.when(~d & p, healthy).when(d & p, preventive).when(~d & ~p, skew).when(d & ~p, urgent)


def traffic_light(compatibility, green: float = 0.40, amber: float = 0.20) -> Column:
    p = _col(compatibility)
    return F.when(p >= green, "green").when(p >= amber, "amber").otherwise("red")


def si_status(broken, total, least: int = 4, high: float = 0.25) -> Column:
    """struct(status, confidence, copies): copies that don't work out of four, rounded half to even."""
    r, t = _col(broken), _col(total)
    share = r / t
    copies = F.bround(4 * share, 0).cast("int")
    row = lambda s, c, k: F.struct(F.lit(s).alias("status"), F.lit(c).cast("string").alias("confidence"), k.alias("copies"))
    return (
        F.when(t < least, row("Insufficient_data", None, F.lit(None).cast("int")))
        .when(copies == 4, row("SC", None, copies))
        .when((copies == 0) | (r < 2), row("SI", None, copies))
        .when(share >= high, row("pSI", "high", copies))
        .otherwise(row("pSI", "low", copies))
    )


def target_copies(status, confidence, broken) -> Column:
    """struct(functional, null_copies, flag): copies of a null-aware genotype."""
    s, c, k = _col(status), _col(confidence), F.coalesce(_col(broken), F.lit(0))
    row = lambda f, n, flag: F.struct(f.cast("int").alias("functional"), n.cast("int").alias("null_copies"), F.lit(flag).alias("flag"))
    si, low, introduced, sc, thin, none, _ = wording.FLAGS
    return (
        F.when(s == "SI", row(F.lit(4), F.lit(0), si))
        .when((s == "pSI") & (c == "low"), row(F.lit(4), F.lit(0), low))
        .when((s == "pSI") & (c == "high") & (k > 0), row(4 - k, k, introduced))
        .when(s == "SC", row(F.lit(0), F.lit(4), sc))
        .when(s == "Insufficient_data", row(F.lit(4), F.lit(0), thin))
        .otherwise(row(F.lit(4), F.lit(0), none))
    )


def null_label(counts: str | Column, null_copies: str | Column) -> Column:
    """Letters by count, most first, then a 0 for each null copy: AAB0."""
    c = F.sort_array(_col(counts), asc=False)
    letters = F.transform(c, lambda n, i: F.repeat(F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1)), n))
    return F.concat(F.array_join(letters, ""), F.repeat(F.lit("0"), _col(null_copies)))


def broken_confidence(distance, stops) -> Column:
    d, s = _col(distance), _col(stops)
    return F.when((d <= 0.005) & (s <= 3), "high").when((d <= 0.05) & (s <= 10), "medium").otherwise("low")


def loss_status(functional, rate) -> Column:
    f, r = _col(functional), _col(rate)
    return F.when(f.isNull(), "NA").when(f == 0, "Complete_loss").when(r < 0.5, "Partial_translation_failure").otherwise("Functional")


def cross_category(class_a, class_b, distance, near: float = 0.04) -> Column:
    """Of a pair with its own distance."""
    d = _col(distance)
    return F.when(_col(class_a) != _col(class_b), "Compatible_cross").when(d == 0, "Incompatible").when(d < near, "Synonymy_test").otherwise("Compatible_within")


def cross_power(carriers) -> Column:
    n = _col(carriers)
    return F.when(n >= 2, "full").when(n == 1, "singleton").otherwise("none")


def redo_priority(n) -> Column:
    n = _col(n)
    return F.when(n == 0, "high").when(n < 2, "medium").otherwise("low")


def pairing(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.when(a.isNull() | b.isNull() | (a == "Unassigned") | (b == "Unassigned"), "any").when(a == b, "within-BL").otherwise("between-BL")


def biological_allele(allele, group) -> Column:
    number = F.regexp_extract(_col(group), r"(\d+)$", 1)
    return F.when(number == "", _col(allele)).otherwise(F.concat(F.lit("Synonymy_group_"), number))


def qc_category(ingroup, final, stage, loss, failure) -> Column:
    """Outcome of a sample: of the ingroup, its state where it was genotyped, a candidate for escape, else what the laboratory has to repeat."""
    i, f, s, l_, m = map(_col, (ingroup, final, stage, loss, failure))
    return (
        F.when(i.cast("string") == "0", "Outgroup")
        .when((f == "Included") & (l_ == "Partial_translation_failure"), "Partial_translation_failure")
        .when(f == "Included", "Functional")
        .when((l_ == "Complete_loss") & (m == "premature_stop"), "SI_escape_candidate")
        .when(s == "Step 9 — too_many_alleles", "Re_DNA_extraction")
        .otherwise("Re_PCR")
    )


def lab_action(category, stage, gene: str = "target") -> Column:
    """struct(action, recommended) of samples to repeat; null for the others."""
    c, s = _col(category), F.coalesce(_col(stage), F.lit(""))
    row = lambda a, r: F.struct(F.lit(a).alias("action"), filled(r, gene=gene).alias("recommended"))
    out = F.when(c == "Re_DNA_extraction", row("Re-DNA-extraction", wording.NEW_DNA))
    for part, text in wording.AGAIN:
        out = out.when((c == "Re_PCR") & s.contains(part), row("Re-PCR", text))
    return out


def audit_decision(genotyped, raw, step4, step4b, step7b, has_4b, has_7b, label, reasons, ingroup, gene: str = "target", low: int = 3250, high: int = 4000) -> Column:
    """struct(status, stage, reason): genotyped samples are included, the others excluded by the first stage that leaves nothing; the outgroup comes last.

    ``has_4b``, ``has_7b``: whether the sample's library has that filter's log. ``label``: the class after translation, ``reasons`` its failures as ``key(n);key(n)``.
    """
    g, r, n4, n4b, n7b, l4b, l7b, c, f, i = map(_col, (genotyped, raw, step4, step4b, step7b, has_4b, has_7b, label, reasons, ingroup))
    none = lambda n: F.coalesce(n, F.lit(0)) == 0
    row = lambda status, stage, reason: F.struct(F.lit(status).alias("status"), stage.alias("stage"), reason.alias("reason"))
    values = {"raw": r, "step4": n4, "step4b": n4b, "gene": gene, "low": low, "high": high}
    excluded = lambda k: row("Excluded", F.lit(wording.STAGES[k][0]), filled(wording.STAGES[k][1], **values))
    base = F.lit(None).cast("string")
    for k, text in wording.CLASSES.items():
        base = F.when(c == k, text).otherwise(base)
    dominant = dominant_reason(F.coalesce(f, F.lit("")))
    for k, text in wording.FAILURES.items():
        base = F.when((c == "no_functional_proteins") & F.coalesce(dominant == k, F.lit(False)), text).otherwise(base)
    failed = row("Excluded", F.concat(F.lit("Step 9 — "), c), F.concat(base, F.lit(" (Top failures: "), F.coalesce(f, F.lit("n/a")), F.lit(")")))
    return (
        F.when(g, row("Included", F.lit(""), F.lit("")))
        .when(none(r), excluded("assembly"))
        .when(none(n4), excluded("length"))
        .when(l4b & none(n4b), excluded("similarity"))
        .when(l7b & none(n7b), excluded("ambiguity"))
        .when(c.isin(*wording.CLASSES), failed)
        .when(i.cast("string") == "0", excluded("outgroup"))
        .otherwise(excluded("unknown"))
    )


def dominant_reason(reasons: str | Column, share: float = 0.5) -> Column:
    """Of ``a(3);b(2)`` the reason with the highest count, ``mixed`` where the second has ``share`` of it."""
    r = F.sort_array(parsed_counts(reasons, ";"), asc=False)
    top, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
    return F.when(F.size(r) <= 0, None).when(F.coalesce(second["n"] >= share * top["n"], F.lit(False)), "mixed").otherwise(top["key"])


def parsed_counts(text: str | Column, by: str = "+", form: str = r"([^+;]+)\((\d+)\)") -> Column:
    """``key(count)+key(count)`` as an array of struct(n, key)."""
    parts = F.split(_col(text), "[" + by + "]")
    one = lambda p: F.struct(F.regexp_extract(p, form, 2).try_cast("int").alias("n"), F.trim(F.regexp_extract(p, form, 1)).alias("key"))
    return F.filter(F.transform(parts, one), lambda x: x["n"].isNotNull())


def bucket(value: str | Column, edges: list[float]) -> Column:
    """Right-closed ranges with the lowest edge included; null outside."""
    v = _col(value)
    out = F.lit(None).cast("string")
    for i in range(len(edges) - 2, -1, -1):
        low = v >= edges[i] if i == 0 else v > edges[i]
        out = F.when(low & (v <= edges[i + 1]), f"{'[' if i == 0 else '('}{edges[i]:g}, {edges[i + 1]:g}]").otherwise(out)
    return out


def collapse_verdict(full, collapsed, other, least: float = 0.05, share: float = 0.5) -> Column:
    """What collapsing groups does to the median positional entropy: ``full`` and ``collapsed`` medians against the ``other`` species' one."""
    f, c, o = map(_col, (full, collapsed, other))
    negligible, substantial, partial, decreased = wording.VERDICTS
    return F.when(F.abs(c - f) < least, negligible).when((c > f) & (c >= share * o), substantial).when(c > f, partial).otherwise(decreased)


#: Thresholds of ``failure_mode``: reads below which a sample is under-sequenced, share of contigs dropped as chimeric, mean quality, N50, long reads.
LOW_READS, MUCH_DROPPED, LOW_QUALITY, SHORT_N50, FEW_LONG = 10_000, 80, 10, 800, 50


def failure_mode(status, action, ok, removed, chimeric, dropped=None, unique=None, contigs=None, within=None, below=None, above=None, median=None, reads=None, quality=None, n50=None, long_reads=None, gene: str = "target", low: int = 3250, high: int = 4000) -> Column:
    """struct(mode, action): why a re-sequenced sample has no call, by the first rule that holds. Columns left out are unknown (null) for all.

    status: as ``si_status`` names it (null: not in its table); action: what the laboratory was asked to do; ok, removed, chimeric: haplotypes; dropped: percentage
    of contigs that the chimera filter took; unique, contigs: after and before deduplication; within, below, above: unique contigs by the length filter's bounds.
    """
    given = (status, action, ok, removed, chimeric, dropped, unique, contigs, within, below, above, median, reads, quality, n50, long_reads)
    st, act, k, rm, ch, dr, un, ca, wi, be, ab, me, re_, q, n, lg = (F.lit(None) if x is None else _col(x) for x in given)
    st, act = st.cast("string"), act.cast("string")
    number = lambda x: x.cast("double")
    dr, un, ca, wi, be, ab, me, re_, q, n, lg = map(number, (dr, un, ca, wi, be, ab, me, re_, q, n, lg))
    zero = lambda x: F.coalesce(x, F.lit(0))
    clean, ch = zero(k) + zero(rm), zero(ch)
    whole = lambda x: x.cast("bigint")
    values = {"gene": gene, "low": low, "high": high, "dropped": F.bround(dr, 0).cast("bigint"), "unique": whole(un), "median": whole(zero(me)), "quality": F.format_string("%.1f", q), "n50": F.format_string("%,d", whole(n)), "long": whole(lg)}
    row = lambda mode, text=None: F.struct(F.lit(mode).alias("mode"), filled(text or wording.MODES[mode], **values).alias("action"))
    outside = (un > 0) & (wi == 0) & (ca > 0)
    empty = ca == 0
    rules = [
        (st.isin("SI", "pSI", "SC") & (clean >= 4), row("none — SI call achieved")),
        (st.isNull() | (st == "Not_in_SI_table"), row("not_in_SI_status_table")),
        (act == "Re-DNA-extraction", row("DNA_contamination")),
        (act == "Re-PCR", row("PCR_amplicon_failure")),
        ((ch >= 2 * F.greatest(clean, F.lit(1))) & (ch >= 4), row("chimera_dominated")),
        ((clean >= 1) & (clean < 4), row("partial_recovery")),
        ((dr >= MUCH_DROPPED) & (un > 0), row("pipeline_chimera_filter_too_aggressive")),
        ((ca > 0) & (un == 0), row("pipeline_dedup_collapsed_all_contigs")),
        (outside & (be > 0) & (zero(ab) == 0), row("pipeline_step4_length_filter_too_short")),
        (outside & (ab > 0) & (zero(be) == 0), row("pipeline_step4_length_filter_too_long")),
        (outside, row("pipeline_step4_length_filter_mixed")),
        (ca > 0, row("pipeline_downstream_filter")),
        (empty & (re_ < LOW_READS), row("coverage_limited")),
        (empty & (q < LOW_QUALITY), row("canu_assembly_failure_low_quality")),
        (empty & (n < SHORT_N50), row("canu_assembly_failure_fragmented")),
        (empty & (lg < FEW_LONG), row("canu_assembly_failure_no_long_reads")),
        (empty, row("canu_assembly_failure")),
        (re_ < LOW_READS, row("coverage_limited", wording.UNDER_SEQUENCED)),
    ]
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(row("unresolved"))
