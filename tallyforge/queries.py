"""The registered queries over derived invoices, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import receipts, similarity, text
from .functions.dates import parse_date
from .operators import cleaning, pairs, rules, stats, vendors
from .plans import audit, check, derive
from .settings import DEFAULT, USD_RATES
from .sources import ingest, scratch, store

Query = Callable[[SparkSession, str], DataFrame]


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(derive.invoices(spark, sf_dir))


def _featured(spark: SparkSession, sf_dir: str, large: bool = False) -> DataFrame:
    rows = cleaning.clean(derive.large_vendors(spark, sf_dir)) if large else _cleaned(spark, sf_dir)
    return stats.add_features(scratch.written(rows, "cleaned"))


def _scored(spark: SparkSession, sf_dir: str) -> audit.Scored:
    return audit.score(derive.invoices(spark, sf_dir))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty invoices as a new batch: negative ids, in the order of their numbers."""
    return derive.invoices(spark, sf_dir).where("is_anomaly = 1").withColumn("id", -F.col("id"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.invoices(spark, sf_dir).where("is_anomaly = 0")


def _vendor_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vendor_id").agg(F.min_by("vendor_name", "id").alias("vendor_name"))


def _checked(spark: SparkSession, sf_dir: str) -> audit.Scored:
    history, new = _history(spark, sf_dir), check.prepare(_batch(spark, sf_dir))
    past = check.relevant_history(history.drop("is_anomaly", "anomaly_type"), new)
    return audit.score(past.unionByName(new))


def exact_duplicates(spark, sf_dir):
    return rules.exact_duplicates(_cleaned(spark, sf_dir)).select(F.col("_id").alias("id"))


def same_number_rebilled(spark, sf_dir):
    c = _cleaned(spark, sf_dir)
    exact = rules.exact_duplicates(c).select(F.col("_id").alias("e"))
    return rules.rebilled(c).join(exact, F.col("_id") == F.col("e"), "left_anti").select(F.col("_id").alias("id"))


def burst_po_date(spark, sf_dir):
    return rules.bursts(_cleaned(spark, sf_dir)).select(F.col("_id").alias("id"))


def _six(c: str):
    return F.round(F.col(c), 6).alias(c)


def vendor_loo_median(spark, sf_dir):
    return _featured(spark, sf_dir).select("id", "vendor_history_count", _six("amount_to_vendor_median"))


def vendor_loo_mad_z(spark, sf_dir):
    return _featured(spark, sf_dir).select("id", F.round("amount_robust_z", 4).alias("amount_robust_z"))


def vendor_group_stats_large(spark, sf_dir):
    return _featured(spark, sf_dir, large=True).select("id", "vendor_history_count", _six("amount_to_vendor_median"), F.round("amount_robust_z", 4).alias("amount_robust_z"))


def overpayment_flags(spark, sf_dir):
    return _featured(spark, sf_dir).withColumn("overpayment", rules._overpayment(DEFAULT)).where("overpayment > 0").select("id", _six("overpayment"))


def round_amounts(spark, sf_dir):
    return _featured(spark, sf_dir).withColumn("s", rules._round_number(DEFAULT)).where("s > 0").select("id", "amount_usd")


def near_dup_candidates(spark, sf_dir):
    return pairs.candidates(scratch.written(_cleaned(spark, sf_dir), "cleaned")).select("i_id", "j_id", "by_block", "same_vendor")


def near_dup_candidate_count(spark, sf_dir):
    found = pairs.candidates(scratch.written(_cleaned(spark, sf_dir), "cleaned"))
    return found.agg(pairs.candidate_count(found).alias("candidates"), F.count(F.lit(1)).alias("pairs"))


def near_dup_pairs(spark, sf_dir):
    return pairs.confirm(pairs.candidates(scratch.written(_cleaned(spark, sf_dir), "cleaned"))).select("record_a_id", "record_b_id", *[F.round(c, 3).alias(c) for c in ("similarity_score", "levenshtein_score", "jaro_winkler_score")], "match_type")


def final_score(spark, sf_dir):
    return _scored(spark, sf_dir).rows.select("id", F.round("final_score", 3).alias("final_score"), "risk_category", "flags")


def risk_tier_counts(spark, sf_dir):
    return _scored(spark, sf_dir).rows.groupBy("risk_category").agg(F.count(F.lit(1)).alias("n"))


def top_risk(spark, sf_dir):
    rows = _scored(spark, sf_dir).rows.where("risk_category <> 'LOW'").select("id", F.round("final_score", 3).alias("final_score"), "risk_category")
    return rows.orderBy(F.desc("final_score"), "id").limit(500)


def verdict_counts(spark, sf_dir):
    rows = _scored(spark, sf_dir).rows
    return rows.groupBy(rules.verdict(F.col("risk_category"), F.col("id") % 1000 == 0).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def evaluate_precision_recall(spark, sf_dir):
    return audit.evaluate(_scored(spark, sf_dir).rows).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


def recall_by_type(spark, sf_dir):
    return audit.recall_by_type(_scored(spark, sf_dir).rows)


def vendor_name_normalize(spark, sf_dir):
    return derive.invoices(spark, sf_dir).select("vendor_name", text.vendor_clean(F.col("vendor_name")).alias("clean")).distinct()


def invoice_key_normalize(spark, sf_dir):
    n = F.col("invoice_id")
    return derive.invoices(spark, sf_dir).select("id", text.invoice_key(n).alias("key"), text.clean_id(n).alias("clean_id"), text.id_shape(text.clean_id(n)).alias("shape"))


def vendor_slug(spark, sf_dir):
    clean = text.vendor_clean(F.col("vendor_name"))
    return derive.invoices(spark, sf_dir).select("vendor_name", text.vendor_slug(clean).alias("slug"), text.name_block(clean, 3).alias("block")).distinct()


def _neighbours(spark, sf_dir) -> DataFrame:
    """Distinct pairs of neighbouring suppliers' and customers' names."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat("c_name", F.lit(" "), F.lower("c_mktsegment")).alias("a"))
    return c.join(c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("a").alias("b")), "c_custkey")


def indel_ratio(spark, sf_dir):
    return _neighbours(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.round(similarity.by_batch(similarity.ratio)("a", "b"), 6).alias("ratio"))


def jaro_winkler(spark, sf_dir):
    return _neighbours(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.round(similarity.by_batch(similarity.jaro_winkler)("a", "b"), 6).alias("jw"))


def name_similarity(spark, sf_dir):
    s = similarity.pair_similarity(F.col("a"), F.col("b"), F.col("a"), F.col("b"))
    rows = _neighbours(spark, sf_dir).withColumn("s", s)
    return rows.select(F.col("c_custkey").alias("id"), F.round(DEFAULT.ratio_weight * F.col("s.name_ratio") + DEFAULT.jaro_winkler_weight * F.col("s.name_jw"), 6).alias("name_similarity"))


def vendor_resolve_exact(spark, sf_dir):
    known = vendors.known_names(_vendor_table(_history(spark, sf_dir))).select("clean", F.col("vendor_id").alias("resolved"))
    rows = derive.invoices(spark, sf_dir).select("id", text.vendor_clean(F.col("vendor_name")).alias("clean"))
    return rows.join(known, "clean").select("id", "resolved")


def vendor_resolve_fuzzy(spark, sf_dir):
    """Names with a letter lost or a word added, resolved against the vendors of the history."""
    table = scratch.written(_vendor_table(_history(spark, sf_dir)), "vendors")
    odd = table.select(F.col("vendor_id").alias("own"), F.when(F.crc32(F.col("vendor_id").cast("binary")) % 2 == 0, F.expr("overlay(vendor_name placing '' from 4 for 1)")).otherwise(F.concat("vendor_name", F.lit(" & sons"))).alias("vendor_name"))
    return vendors.resolve_vendors(odd.withColumn("vendor_id", F.lit(None).cast("string")), table).select("own", "vendor_name", "vendor_id")


def closest_vendor(spark, sf_dir):
    table = scratch.written(_vendor_table(_history(spark, sf_dir)), "vendors")
    odd = table.select(F.expr("overlay(vendor_name placing 'x' from 2 for 1)").alias("vendor_name"))
    return vendors.closest_vendors(odd, table)


def vendor_merge_map(spark, sf_dir):
    rows = derive.invoices(spark, sf_dir).withColumn("vendor_id", F.concat(F.lit("V-"), "vendor_id"))
    return vendors.merge_map(_vendor_table(rows), rows)


def vendor_merge_invoices(spark, sf_dir):
    rows = derive.invoices(spark, sf_dir).withColumn("vendor_id", F.concat(F.lit("V-"), "vendor_id"))
    return vendors.merge_split_vendors(_vendor_table(rows), rows)[1].select("id", "vendor_id")


def import_anti_join(spark, sf_dir):
    rows = derive.invoices(spark, sf_dir)
    return ingest.not_recorded(rows, rows.where("is_anomaly = 0")).select("id", "invoice_id", "vendor_id")


def fx_convert(spark, sf_dir):
    own = spark.createDataFrame([(" eur", 1.5), ("GBP", 2.0)], "currency string, usd_per_unit double")
    rates = cleaning.usd_rates(spark, own)
    return cleaning.clean(derive.invoices(spark, sf_dir), rates).select("id", "currency", F.round("amount_usd", 4).alias("amount_usd"))


def _export(spark, sf_dir) -> DataFrame:
    """Invoices as a loose export: own headings, all text, some rows broken."""
    d = F.col("invoice_date")
    date = F.when(F.col("id") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("id") % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "d.M.yyyy"))
    amount = F.concat(F.lit("$ "), F.floor("amount").cast("string"), F.lit("."), F.lpad((F.col("id") % 100).cast("string"), 2, "0"))
    return derive.invoices(spark, sf_dir).select(
        F.when(F.col("id") % 41 != 0, F.col("invoice_id")).alias("Invoice No."), F.concat(F.lit("  "), "vendor_name", F.lit(" ")).alias("Supplier"), F.when(F.col("id") % 43 == 0, "no date").otherwise(date).alias("Posting_Date"),
        F.when(F.col("id") % 47 == 0, "n/a").otherwise(amount).alias("TOTAL"), F.lower("currency").alias("ccy"), F.col("id").alias("row"),
    )


def alias_clean_amount(spark, sf_dir):
    raw = _export(spark, sf_dir)
    rows = ingest.coerced(raw.withColumn("Ref", F.col("row").cast("string")), ingest.map_columns(raw.columns) | {"department": "Ref"}, True)
    return rows.select(F.col("department").cast("long").alias("id"), "invoice_id", "vendor_name", F.round("amount", 2).alias("amount"), "currency")


def date_parse_mixed(spark, sf_dir):
    return _export(spark, sf_dir).select(F.col("row").alias("id"), F.date_format(parse_date(F.col("Posting_Date"), True), "yyyy-MM-dd").alias("parsed"))


def dayfirst_detect(spark, sf_dir):
    return ingest.day_first_evidence(_export(spark, sf_dir), "Posting_Date").select("day_first", F.col("warning").isNotNull().alias("warned"))


def bad_row_filter(spark, sf_dir):
    raw = _export(spark, sf_dir)
    rows = ingest.coerced(raw, ingest.map_columns(raw.columns), True)
    return rows.groupBy("bad").agg(F.count(F.lit(1)).alias("n"))


def csv_formula_escape(spark, sf_dir):
    odd = F.concat(F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", "", "a"))), (1 + F.col("id") % 6).cast("int")), "vendor_name")
    return store.csv_escaped(derive.invoices(spark, sf_dir).select("id", odd.alias("vendor_name"), "amount"))


def markdown_escape(spark, sf_dir):
    return derive.invoices(spark, sf_dir).select("vendor_name", text.markdown_safe(F.col("vendor_name")).alias("escaped")).distinct()


def history_pruning(spark, sf_dir):
    return check.relevant_history(_history(spark, sf_dir), _batch(spark, sf_dir)).select("id")


def check_batch(spark, sf_dir):
    rows = _checked(spark, sf_dir).rows.where("id < 0")
    return rows.select("id", F.round("final_score", 3).alias("final_score"), "risk_category", rules.verdict(F.col("risk_category")).alias("verdict"), "flags")


def related_records(spark, sf_dir):
    done = _checked(spark, sf_dir)
    return check.related_records(audit.Scored(scratch.written(done.rows, "scored"), done.pairs, done.candidates)).select("new_id", "record_id", "match_type", "invoice_id", "vendor_name", "invoice_date", F.round("amount", 4).alias("amount"))


def reasons_text(spark, sf_dir):
    history = _history(spark, sf_dir)
    out, _ = check.check(history.drop("is_anomaly", "anomaly_type"), _vendor_table(history), _batch(spark, sf_dir))
    return out.select("id", "verdict", "flags", "reasons")


def check_log_projection(spark, sf_dir):
    rows = _scored(spark, sf_dir).rows.withColumn("verdict", rules.verdict(F.col("risk_category")))
    return store.check_log(rows, "batch", "upload.csv", None, None, "auditor").where("verdict <> 'OK'").withColumns({"amount": F.round("amount", 4), "final_score": F.round("final_score", 3)})


def receipt_fields(spark, sf_dir):
    rows = scratch.spread(derive.receipts(spark, sf_dir)).select("id", receipts.fields(F.col("receipt")).alias("f"))
    return rows.select("id", "f.vendor_name", F.date_format("f.invoice_date", "yyyy-MM-dd").alias("invoice_date"), "f.amount", "f.currency")


def receipt_invoice_number(spark, sf_dir):
    return scratch.spread(derive.receipts(spark, sf_dir)).select("id", receipts.invoice_number(F.col("receipt")).alias("invoice_id"))


def documents_amounts(spark, sf_dir):
    """Amounts and currencies in ordinary documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(receipts.amounts(F.col("text"))).alias("n_amounts"), receipts.currency(F.col("text")).alias("currency"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    exact_duplicates, same_number_rebilled, burst_po_date, vendor_loo_median, vendor_loo_mad_z, vendor_group_stats_large, overpayment_flags, round_amounts, near_dup_candidates, near_dup_candidate_count,
    near_dup_pairs, final_score, risk_tier_counts, top_risk, verdict_counts, evaluate_precision_recall, recall_by_type, vendor_name_normalize, invoice_key_normalize, vendor_slug, indel_ratio, jaro_winkler,
    name_similarity, vendor_resolve_exact, vendor_resolve_fuzzy, closest_vendor, vendor_merge_map, vendor_merge_invoices, import_anti_join, fx_convert, alias_clean_amount, date_parse_mixed, dayfirst_detect,
    bad_row_filter, csv_formula_escape, markdown_escape, history_pruning, check_batch, related_records, reasons_text, check_log_projection, receipt_fields, receipt_invoice_number, documents_amounts,
)}


# The SQL, from shared pieces.

_FORMS = "|".join(text.LEGAL_FORMS)
_INV = f"inv AS MATERIALIZED ({derive.INVOICES.format(orders='orders')})"


def _clean_sql(name: str) -> str:
    plain = rf"regexp_replace(regexp_replace(lower(trim({name})), '[.,]', '', 'g'), '^the\s+', '')"
    squeeze = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    bare = squeeze(rf"regexp_replace(regexp_replace({plain}, '\(.*?\)', ' ', 'g'), '\b({_FORMS})\b', '', 'g')")
    return f"CASE WHEN {bare} <> '' THEN {bare} ELSE {squeeze(plain)} END"


_RATE = "CASE currency " + " ".join(f"WHEN '{c}' THEN {r}::DOUBLE" for c, r in USD_RATES.items()) + " ELSE 1.0::DOUBLE END"
_KEY = "regexp_replace(upper(invoice_id), '[^A-Z0-9]', '', 'g')"
_CLEAN_ID = "upper(replace(replace(invoice_id, '-', ''), ' ', ''))"
_CL = f"cl AS MATERIALIZED (SELECT *, amount::DOUBLE * {_RATE} AS amount_usd, {_KEY} AS key, {_CLEAN_ID} AS cid, regexp_replace({_CLEAN_ID}, '[0-9]', '#', 'g') AS shape, nm[1:3] AS block FROM (SELECT *, {_clean_sql('vendor_name')} AS nm FROM inv))"


def _features_sql(src: str = "cl") -> str:
    """Leave-one-out medians by a self-join for small vendors, whole-group ones for large."""
    return f"""g AS MATERIALIZED (SELECT *, ln(greatest(amount_usd, 0.01)) AS lg, count(*) OVER (PARTITION BY vendor_id) AS m FROM {src}),
o AS MATERIALIZED (SELECT a.id, median(b.amount_usd) AS med, median(b.lg) AS lmed FROM g a JOIN g b ON a.vendor_id = b.vendor_id AND a.id <> b.id WHERE a.m <= 500 GROUP BY a.id
  UNION ALL SELECT a.id, s.med, s.lmed FROM g a JOIN (SELECT vendor_id, median(amount_usd) AS med, median(lg) AS lmed FROM g WHERE m > 500 GROUP BY vendor_id) s USING (vendor_id) WHERE a.m > 500),
dv AS MATERIALIZED (SELECT a.id, median(abs(b.lg - o.lmed)) AS lmad FROM g a JOIN o ON a.id = o.id JOIN g b ON a.vendor_id = b.vendor_id AND a.id <> b.id WHERE a.m <= 500 GROUP BY a.id
  UNION ALL SELECT a.id, s.lmad FROM g a JOIN (SELECT g.vendor_id, median(abs(g.lg - o.lmed)) AS lmad FROM g JOIN o USING (id) WHERE m > 500 GROUP BY g.vendor_id) s USING (vendor_id) WHERE a.m > 500),
ft AS MATERIALIZED (SELECT g.*, (m - 1)::DOUBLE AS hist, CASE WHEN med > 0 THEN amount_usd / med ELSE 1.0::DOUBLE END AS ratio,
  coalesce(CASE WHEN lmad IS NULL THEN 0.0::DOUBLE WHEN lmad = 0 AND abs(lg - lmed) <= 1e-8 + 1e-5 * abs(lmed) THEN 0.0::DOUBLE WHEN lmad = 0 THEN sign(lg - lmed) * 50.0::DOUBLE ELSE greatest(-50.0::DOUBLE, least(50.0::DOUBLE, (lg - lmed) / (1.4826::DOUBLE * lmad))) END, 0.0::DOUBLE) AS z
  FROM g LEFT JOIN o USING (id) LEFT JOIN dv USING (id))"""


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence: rows of the table of prefixes, each folded from the one above."""
    chars = lambda s: f"list_transform(string_split({s}, ''), lambda ch: [ord(ch)])"
    zero = f"list_transform(range(0, strlen({b}) + 1), lambda q: 0)"
    cell = f"CASE WHEN ord({b}[j[1]]) = e[1] THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], acc[j[1]]) END"
    row = f"list_reduce(list_transform(range(1, strlen({b}) + 1), lambda q: [q::INT]), lambda acc, j: list_append(acc, {cell}), [0])"
    return f"list_reduce({chars(a)}, lambda above, e: {row}, {zero})[-1]"


def _ratio_sql(a: str, b: str) -> str:
    return f"(2.0::DOUBLE * {lcs_sql(a, b)} / (strlen({a}) + strlen({b})))"


_CAND = """cand AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT i.id AS i, j.id AS j FROM cl i JOIN cl j ON i.block = j.block AND i.block <> '' AND j.amount_usd BETWEEN i.amount_usd AND i.amount_usd * (1 + 0.005::DOUBLE) + 0.01::DOUBLE AND abs(i.invoice_date - j.invoice_date) <= 7
    UNION ALL SELECT i.id, j.id FROM cl i JOIN cl j ON i.vendor_id = j.vendor_id AND j.amount_usd BETWEEN i.amount_usd AND i.amount_usd * (1 + 0.005::DOUBLE) + 0.01::DOUBLE AND abs(i.invoice_date - j.invoice_date) <= 7)),
pr AS MATERIALIZED (SELECT i.id AS i_id, j.id AS j_id, i.block = j.block AND i.block <> '' AS by_block, i.vendor_id = j.vendor_id AS same_vendor, i.cid AS ci, j.cid AS cj, i.nm AS ni, j.nm AS nj, i.shape AS si, j.shape AS sj, i.invoice_date AS di, j.invoice_date AS dj
  FROM cand JOIN cl i ON cand.i = i.id JOIN cl j ON cand.j = j.id WHERE (i.amount_usd < j.amount_usd OR i.id < j.id) AND NOT (i.invoice_id = j.invoice_id AND i.vendor_id = j.vendor_id))"""
_PAIRS = _CAND + f""",
sc AS MATERIALIZED (SELECT *, same_vendor AND ci = cj AS same_id, {_ratio_sql('ci', 'cj')} AS ids, {_ratio_sql('ni', 'nj')} AS lev, jaro_winkler_similarity(ni, nj) AS jw FROM pr WHERE (same_vendor AND ci = cj) OR si <> sj OR di = dj),
sm AS MATERIALIZED (SELECT *, 0.4::DOUBLE * lev + 0.6::DOUBLE * jw AS ns, same_vendor AND ids >= 0.85 AS near_id FROM sc),
np AS MATERIALIZED (SELECT CASE WHEN dj > di OR (dj = di AND j_id > i_id) THEN i_id ELSE j_id END AS ra, CASE WHEN dj > di OR (dj = di AND j_id > i_id) THEN j_id ELSE i_id END AS rb,
  greatest(ns, CASE WHEN near_id THEN ids WHEN same_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sim, lev, jw, CASE WHEN same_id OR near_id THEN 'cross_erp_id' ELSE 'vendor_variant' END AS match_type
  FROM sm WHERE same_id OR near_id OR (ns >= 0.85 AND (same_vendor OR ns >= 0.90) AND ids >= 0.70))"""
_FLIP = "npf AS MATERIALIZED (SELECT CASE WHEN ra < 0 AND rb > 0 THEN rb ELSE ra END AS ra, CASE WHEN ra < 0 AND rb > 0 THEN ra ELSE rb END AS rb, sim, match_type FROM np)"
_SEQ = "(id < 0), abs(id)"
_EXACT = f"row_number() OVER (PARTITION BY vendor_id, key, amount_usd ORDER BY {_SEQ}) > 1"
_OVER = "CASE WHEN hist >= 3 AND ratio >= 3 AND z >= 3.5 THEN greatest(0.85::DOUBLE, least(greatest(ratio - 1, 0), 5) / 5) WHEN hist >= 3 AND ratio >= 2 AND z >= 2.5 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END"
_ROUND = "CASE WHEN amount_usd >= 25000 AND amount_usd % 5000 = 0 AND ratio >= 2.5 THEN 0.65::DOUBLE ELSE 0.0::DOUBLE END"
_SCORE = f"""w AS MATERIALIZED (SELECT *, {_EXACT} AS ex, count(*) OVER (PARTITION BY vendor_id, key) AS uses, row_number() OVER (PARTITION BY vendor_id, key ORDER BY {_SEQ}) AS nth, CASE WHEN po_number IS NOT NULL THEN count(invoice_id) OVER (PARTITION BY vendor_id, po_number, invoice_date) ELSE 0 END AS burst FROM ft),
sr AS MATERIALIZED (SELECT w.*, CASE WHEN ex THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r1, coalesce(near.sim, 0.0::DOUBLE) AS r2, CASE WHEN key <> '' AND uses = 2 AND nth = 2 AND NOT ex THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS r3, {_OVER} AS r4, CASE WHEN burst >= 3 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS r5, {_ROUND} AS r6
  FROM w LEFT JOIN (SELECT rb, max(sim) AS sim FROM npf GROUP BY rb) near ON near.rb = w.id),
fs AS MATERIALIZED (SELECT *, CASE WHEN s >= 0.8 THEN 'HIGH' WHEN s >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_category, CASE WHEN s > 0 THEN concat_ws(',', CASE WHEN r1 > 0 THEN 'exact_dup' END, CASE WHEN r2 > 0 THEN 'near_dup' END, CASE WHEN r3 > 0 THEN 'same_number' END, CASE WHEN r4 > 0 THEN 'overpayment' END, CASE WHEN r5 > 0 THEN 'rapid_fire' END, CASE WHEN r6 > 0 THEN 'round_number' END) ELSE 'none' END AS flags
  FROM (SELECT *, least(greatest(r1, r2, r3, r4, r5, r6), 1.0::DOUBLE) AS s FROM sr))"""
_NEW = f"base AS MATERIALIZED ({derive.INVOICES.format(orders='orders')}), nw AS MATERIALIZED (SELECT -id AS id, * EXCLUDE (id) FROM base WHERE is_anomaly = 1)"
_INV_CHECK = _NEW + f", hs AS MATERIALIZED (SELECT *, ({_clean_sql('vendor_name')})[1:3] AS bl FROM base WHERE is_anomaly = 0), inv AS MATERIALIZED (SELECT * EXCLUDE (bl) FROM hs WHERE vendor_id IN (SELECT vendor_id FROM nw) OR bl IN (SELECT ({_clean_sql('vendor_name')})[1:3] FROM nw) UNION ALL SELECT * FROM nw)"
_VERDICT = "CASE risk_category WHEN 'HIGH' THEN 'SUSPICIOUS' WHEN 'MEDIUM' THEN 'REVIEW' ELSE 'OK' END"
_ALL = f"WITH {_INV}, {_CL}, {_features_sql()}, {_PAIRS}, {_FLIP}, {_SCORE}"
_CHECKED = f"WITH {_INV_CHECK}, {_CL}, {_features_sql()}, {_PAIRS}, {_FLIP}, {_SCORE}"
_NEIGHBOURS = "nb AS MATERIALIZED (SELECT x.c_custkey AS id, x.c_name || ' ' || lower(x.c_mktsegment) AS a, y.c_name || ' ' || lower(y.c_mktsegment) AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1)"
_AMOUNT_TEXT = "CASE WHEN id % 47 = 0 THEN 'n/a' ELSE '$ ' || CAST(floor(amount) AS BIGINT)::VARCHAR || '.' || lpad((id % 100)::VARCHAR, 2, '0') END"
_V = "v AS MATERIALIZED (SELECT vendor_id, arg_min(vendor_name, id) AS vendor_name, count(*) AS n FROM (SELECT * REPLACE ('V-' || vendor_id AS vendor_id) FROM inv) GROUP BY vendor_id), k AS MATERIALIZED (SELECT *, " + _clean_sql("vendor_name") + " AS c FROM v), mm AS MATERIALIZED (SELECT vendor_id, first_value(vendor_id) OVER (PARTITION BY c ORDER BY n DESC, vendor_id) AS keep FROM k)"

# Without lookaround: an amount's first digit stands behind the start or a sign that is neither digit nor stop, and what is behind it is looked at by itself.
_AMOUNTS_SQL = r"list_filter(regexp_extract_all(' ' || text, '[^0-9.](?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)\.[0-9]+'), lambda a: regexp_matches(a, '\.[0-9]{2}$'))"
_CURRENCY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in receipts.CURRENCIES) + " END"

ORACLE_SQL = {
    "exact_duplicates": f"WITH {_INV}, {_CL} SELECT id FROM (SELECT id, {_EXACT} AS x FROM cl) WHERE x",
    "same_number_rebilled": f"WITH {_INV}, {_CL} SELECT id FROM (SELECT id, key, {_EXACT} AS x, count(*) OVER (PARTITION BY vendor_id, key) AS n, row_number() OVER (PARTITION BY vendor_id, key ORDER BY {_SEQ}) AS k FROM cl) WHERE key <> '' AND n = 2 AND k = 2 AND NOT x",
    "burst_po_date": f"WITH {_INV} SELECT id FROM (SELECT id, count(invoice_id) OVER (PARTITION BY vendor_id, po_number, invoice_date) AS n FROM inv WHERE po_number IS NOT NULL) WHERE n >= 3",
    "vendor_loo_median": f"WITH {_INV}, {_CL}, {_features_sql()} SELECT id, hist AS vendor_history_count, round(ratio, 6) AS amount_to_vendor_median FROM ft",
    "vendor_loo_mad_z": f"WITH {_INV}, {_CL}, {_features_sql()} SELECT id, round(z, 4) + 0.0::DOUBLE AS amount_robust_z FROM ft",
    "vendor_group_stats_large": f"WITH inv AS ({derive.LARGE.format(lineitem='lineitem')}), cl AS MATERIALIZED (SELECT *, amount AS amount_usd FROM inv), {_features_sql()} SELECT id, hist AS vendor_history_count, round(ratio, 6) AS amount_to_vendor_median, round(z, 4) + 0.0::DOUBLE AS amount_robust_z FROM ft",
    "overpayment_flags": f"WITH {_INV}, {_CL}, {_features_sql()} SELECT id, round({_OVER}, 6) AS overpayment FROM ft WHERE {_OVER} > 0",
    "round_amounts": f"WITH {_INV}, {_CL}, {_features_sql()} SELECT id, amount_usd FROM ft WHERE {_ROUND} > 0",
    "near_dup_candidates": f"WITH {_INV}, {_CL}, {_CAND} SELECT i_id, j_id, by_block, same_vendor FROM pr",
    "near_dup_candidate_count": f"WITH {_INV}, {_CL}, {_CAND} SELECT count(*) + count(*) FILTER (by_block AND same_vendor) AS candidates, count(*) AS pairs FROM pr",
    "near_dup_pairs": f"WITH {_INV}, {_CL}, {_PAIRS} SELECT ra AS record_a_id, rb AS record_b_id, round(sim, 3) AS similarity_score, round(lev, 3) AS levenshtein_score, round(jw, 3) AS jaro_winkler_score, match_type FROM np",
    "final_score": f"{_ALL} SELECT id, round(s, 3) AS final_score, risk_category, flags FROM fs",
    "risk_tier_counts": f"{_ALL} SELECT risk_category, count(*) AS n FROM fs GROUP BY risk_category",
    "top_risk": f"{_ALL} SELECT id, round(s, 3) AS final_score, risk_category FROM fs WHERE risk_category <> 'LOW' ORDER BY round(s, 3) DESC, id LIMIT 500",
    "verdict_counts": f"{_ALL} SELECT CASE WHEN risk_category = 'HIGH' THEN 'SUSPICIOUS' WHEN risk_category = 'MEDIUM' OR id % 1000 = 0 THEN 'REVIEW' ELSE 'OK' END AS verdict, count(*) AS n FROM fs GROUP BY 1",
    "evaluate_precision_recall": f"{_ALL} SELECT count(*) AS labelled, count(*) FILTER (is_anomaly = 1) AS known_bad, count(*) FILTER (risk_category = 'HIGH') AS flagged, round(count(*) FILTER (is_anomaly = 1 AND risk_category = 'HIGH')::DOUBLE / count(*) FILTER (risk_category = 'HIGH'), 6) AS precision, round(count(*) FILTER (is_anomaly = 1 AND risk_category = 'HIGH')::DOUBLE / count(*) FILTER (is_anomaly = 1), 6) AS recall FROM fs",
    "recall_by_type": f"{_ALL} SELECT anomaly_type, round(avg(CASE WHEN risk_category = 'HIGH' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS recall FROM fs WHERE is_anomaly = 1 GROUP BY anomaly_type",
    "vendor_name_normalize": f"WITH {_INV} SELECT DISTINCT vendor_name, {_clean_sql('vendor_name')} AS clean FROM inv",
    "invoice_key_normalize": f"WITH {_INV} SELECT id, {_KEY} AS key, {_CLEAN_ID} AS clean_id, regexp_replace({_CLEAN_ID}, '[0-9]', '#', 'g') AS shape FROM inv",
    "vendor_slug": f"WITH {_INV}, c AS (SELECT vendor_name, {_clean_sql('vendor_name')} AS nm FROM inv) SELECT DISTINCT vendor_name, 'V-' || coalesce(nullif(upper(regexp_replace(regexp_replace(nm, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:40]), ''), 'UNKNOWN') AS slug, nm[1:3] AS block FROM c",
    "indel_ratio": f"WITH {_NEIGHBOURS} SELECT id, round({_ratio_sql('a', 'b')}, 6) AS ratio FROM nb",
    "jaro_winkler": f"WITH {_NEIGHBOURS} SELECT id, round(jaro_winkler_similarity(a, b), 6) AS jw FROM nb",
    "name_similarity": f"WITH {_NEIGHBOURS} SELECT id, round(0.4::DOUBLE * {_ratio_sql('a', 'b')} + 0.6::DOUBLE * jaro_winkler_similarity(a, b), 6) AS name_similarity FROM nb",
    "vendor_resolve_exact": f"WITH {_INV}, v AS (SELECT vendor_id, arg_min(vendor_name, id) AS vendor_name FROM inv WHERE is_anomaly = 0 GROUP BY vendor_id), k AS (SELECT c, max(vendor_id) AS resolved FROM (SELECT vendor_id, {_clean_sql('vendor_name')} AS c FROM v) GROUP BY c) SELECT id, resolved FROM (SELECT id, {_clean_sql('vendor_name')} AS c FROM inv) JOIN k USING (c)",
    "vendor_merge_map": f"WITH {_INV}, {_V} SELECT vendor_id, keep FROM mm WHERE vendor_id <> keep",
    "vendor_merge_invoices": f"WITH {_INV}, {_V} SELECT id, keep AS vendor_id FROM inv JOIN mm ON mm.vendor_id = 'V-' || inv.vendor_id",
    "import_anti_join": f"WITH {_INV} SELECT id, invoice_id, vendor_id FROM inv a WHERE NOT EXISTS (SELECT 1 FROM inv b WHERE b.is_anomaly = 0 AND a.vendor_id = b.vendor_id AND a.invoice_id = b.invoice_id AND a.invoice_date = b.invoice_date AND a.amount = b.amount)",
    "fx_convert": f"WITH {_INV} SELECT id, currency, round(amount * CASE currency WHEN 'EUR' THEN 1.5::DOUBLE WHEN 'GBP' THEN 2.0::DOUBLE ELSE {_RATE} END, 4) AS amount_usd FROM inv",
    "alias_clean_amount": f"WITH {_INV} SELECT id, CASE WHEN id % 41 <> 0 THEN invoice_id END AS invoice_id, trim(vendor_name) AS vendor_name, round(TRY_CAST(regexp_replace({_AMOUNT_TEXT}, '[^0-9.\\-]', '', 'g') AS DOUBLE), 2) AS amount, currency FROM inv",
    "date_parse_mixed": f"WITH {_INV} SELECT id, CASE WHEN id % 43 <> 0 THEN strftime(invoice_date, '%Y-%m-%d') END AS parsed FROM inv",
    "dayfirst_detect": f"WITH {_INV}, d AS (SELECT day(invoice_date) AS p, month(invoice_date) AS q FROM inv WHERE id % 3 <> 0 AND id % 43 <> 0) SELECT bool_or(p > 12) AS day_first, bool_or(p > 12) = bool_or(q > 12) AS warned FROM d",
    "bad_row_filter": f"WITH {_INV} SELECT id % 41 = 0 OR id % 43 = 0 OR id % 47 = 0 AS bad, count(*) AS n FROM inv GROUP BY 1",
    "csv_formula_escape": f"WITH {_INV} SELECT id, CASE WHEN id % 6 < 4 THEN '''' ELSE '' END || (['=', '+', '-', '@', '', 'a'])[1 + id % 6] || vendor_name AS vendor_name, amount FROM inv",
    "markdown_escape": f"WITH {_INV} SELECT DISTINCT vendor_name, regexp_replace(vendor_name, '([[:punct:]])', '\\\\\\1', 'g') AS escaped FROM inv",
    "history_pruning": f"WITH {_INV_CHECK} SELECT id FROM inv WHERE id >= 0",
    "check_batch": f"{_CHECKED} SELECT id, round(s, 3) AS final_score, risk_category, {_VERDICT} AS verdict, flags FROM fs WHERE id < 0",
    "related_records": f"""{_CHECKED}, same AS MATERIALIZED (SELECT a.id AS new_id, b.id AS record_id, CASE WHEN a.amount_usd = b.amount_usd THEN 'exact' ELSE 'same number' END AS match_type FROM fs a JOIN fs b ON a.vendor_id = b.vendor_id AND a.key = b.key
  WHERE a.id < 0 AND a.key <> '' AND (b.id > 0 OR b.id > a.id) AND (a.amount_usd = b.amount_usd OR contains(a.flags, 'same_number'))),
every AS (SELECT * FROM same UNION ALL SELECT rb, ra, match_type FROM npf WHERE rb < 0 AND NOT EXISTS (SELECT 1 FROM same s WHERE s.new_id = rb AND s.record_id = ra))
SELECT new_id, record_id, match_type, b.invoice_id, b.vendor_name, strftime(b.invoice_date, '%Y-%m-%d') AS invoice_date, round(b.amount, 4) AS amount FROM every JOIN fs b ON b.id = record_id""",
    "check_log_projection": f"{_ALL} SELECT 'batch' AS source, 'upload.csv' AS file_name, invoice_id, vendor_name, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, round(amount, 4) AS amount, currency, round(s, 3) AS final_score, risk_category, flags, NULL::DOUBLE AS tamper_score, {_VERDICT} AS verdict, 'auditor' AS checked_by FROM fs WHERE risk_category <> 'LOW'",
    "receipt_fields": f"WITH {_INV} SELECT id, vendor_name, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, (CAST(floor(amount) AS BIGINT)::VARCHAR || '.' || lpad((id % 100)::VARCHAR, 2, '0'))::DOUBLE AS amount, CASE currency WHEN 'EUR' THEN 'EUR' WHEN 'INR' THEN 'INR' ELSE 'USD' END AS currency FROM inv",
    "documents_amounts": rf"SELECT doc_id, coalesce(len({_AMOUNTS_SQL}), 0)::INTEGER AS n_amounts, {_CURRENCY_SQL} AS currency FROM documents",
    "receipt_invoice_number": f"WITH {_INV} SELECT id, replace(invoice_id, '-', '') AS invoice_id FROM inv",
}
