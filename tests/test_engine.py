"""The invoice engine: parsing, cleaning, rules, check and audit end to end."""

import datetime as dt
import itertools
import random
import statistics
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import images, receipts, similarity, text
from tallyforge.functions.dates import parse_date
from tallyforge.operators import cleaning, pairs, rules, stats, tamper, vendors
from tallyforge.plans import audit, check
from tallyforge.settings import Settings
from tallyforge.sources import ingest, receipt_files
from tallyforge.sources.store import Store, csv_escaped, read_rates, save_rates

INV = "id long, invoice_id string, vendor_id string, vendor_name string, invoice_date date, amount double, currency string, po_number string"


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def invoices(spark, rows):
    day = lambda x: dt.date.fromisoformat(x)
    full = [(i, num, vid, name, day(d), a, *(more + ("USD", None)[len(more) :])) for i, num, vid, name, d, a, *m in rows for more in [tuple(m)]]
    return spark.createDataFrame(full, INV)


@pytest.mark.parametrize(("name", "clean"), [("ACME Corp., LLC", "acme"), ("TRI SHAAS SDN BHD (728515-M)", "tri shaas"), ("The Acme Co", "acme"), (None, ""), ("(SEMENYIH) SDN BHD", "(semenyih) sdn bhd"), ("  Ångström\u00a0 GmbH ", "ångström"), ("Limited", "limited")])
def test_vendor_clean(spark, name, clean):
    assert one(spark, name, text.vendor_clean) == clean


def test_keys_and_slugs(spark):
    assert one(spark, "sap-2024/1 a", text.invoice_key) == "SAP20241A" and one(spark, "inv- 05/01", text.clean_id) == "INV05/01"
    assert one(spark, "INV05/01", text.id_shape) == "INV##/##" and one(spark, "metro & print", text.vendor_slug) == "V-METRO-PRINT" and one(spark, "!!", text.vendor_slug) == "V-UNKNOWN"
    assert one(spark, "=1+1", text.csv_safe) == "'=1+1" and one(spark, "a=1", text.csv_safe) == "a=1" and one(spark, "a*b_c", text.markdown_safe) == r"a\*b\_c"
    assert text.header_name(" Invoice_No.:#2 ") == "invoice no 2"


def test_similarity_by_hand():
    assert similarity.ratio("kitten", "sitting") == pytest.approx(8 / 13) and similarity.ratio("", "") == 1 and similarity.ratio("a", "") == 0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and similarity.jaro_winkler("dwayne", "duane") == pytest.approx(0.84)
    assert similarity.partial_ratio("abc", "xxabcxx") == 1 and similarity.token_ratio("b a", "a b") == 1 and similarity.weighted_ratio("", "a") == 0
    r = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b)), lambda left, j, row=row, x=x: row[j] + 1 if x == b[j] else max(row[j + 1], left), initial=0))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(90))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == slow(a, b)


def test_choices_are_searched_as_if_one_by_one():
    r = random.Random(2)
    names = list({" ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 3))) for _ in range(120)})
    c = similarity.Choices(names)

    def first(scores, least):
        best = max(scores)
        return (best, scores.index(best)) if best >= least else (None, -1)

    for _ in range(60):
        n = list(r.choice(names))
        for _ in range(r.randrange(4)):
            n[r.randrange(len(n))] = r.choice("abcdef ")
        n = "".join(n)
        assert c.by_ratio(n, 0.6) == first([similarity.ratio(n, x) for x in names], 0.6)
        assert c.by_part(n, 0.7, 0) == first([similarity.partial_ratio(n, x) for x in names], 0.7)
        assert c.by_weight(n, 0.5) == first([similarity.weighted_ratio(n, x) for x in names], 0.5)


@pytest.mark.parametrize(("value", "day_first", "iso"), [
    ("2024-03-12", True, "2024-03-12"), ("2024/3/2", False, "2024-03-02"), ("20240312", True, "2024-03-12"), ("03/01/2024", True, "2024-01-03"), ("03/01/2024", False, "2024-03-01"), ("01/13/2024", True, "2024-01-13"),
    ("13.01.24", False, "2024-01-13"), ("12 Mar 2024", True, "2024-03-12"), ("March 12, 2024", True, "2024-03-12"), ("12-Mar-24", True, "2024-03-12"), ("12MAR2024", True, "2024-03-12"), ("2024-03-12T10:15:00", True, "2024-03-12"),
    ("5/6/99", True, "1999-06-05"), ("soon", True, None), ("31/02/2024", True, None), ("", True, None), (None, True, None),
])
def test_dates(spark, value, day_first, iso):
    got = one(spark, value, lambda c: parse_date(c, day_first))
    assert (got and got.isoformat()) == iso


@pytest.mark.parametrize(("dates", "want"), [(["13/01/2024", "02/03/2024"], (True, False)), (["01/13/2024"], (False, False)), (["13/01/2024", "01/13/2024"], (True, True)), (["03/01/2024"], (False, True)), (["2024-01-13", None], (False, False))])
def test_day_first_evidence(spark, dates, want):
    r = ingest.day_first_evidence(spark.createDataFrame([(d,) for d in dates], "d string"), "d").first()
    assert (r.day_first, r.warning is not None) == want


def test_normalize_maps_columns_and_reports(spark):
    raw = spark.createDataFrame([("INV-1", "Acme", "2024-01-02", "$1,200.50", "usd"), (" ", "Acme", "2024-01-02", "5", None), ("INV-3", "Acme", "bad", "(7.00)", None), ("00123", "Acme", "2024-01-03", "(100.00)", None)], "`Invoice No` string, Supplier string, `Posting Date` string, Total string, ccy string")
    rows, problems = ingest.normalize(raw)
    assert [(r.invoice_id, r.amount, r.currency) for r in rows.orderBy("amount").collect()] == [("00123", 100.0, "USD"), ("INV-1", 1200.5, "USD")]
    assert problems == ["Skipped 2 row(s) with a missing or unreadable invoice number, vendor, date or amount."]
    rows, problems = ingest.normalize(raw.drop("Total"))
    assert rows.count() == 0 and problems[0].startswith("Missing required column(s): amount")


def test_receipt_fields(spark):
    t = "OFFICIAL RECEIPT\nSYARIKAT HARDWARE SDN BHD (12345-X)\nLOT 3, JALAN PELABUR 23/1,\n40300 SHAH ALAM\nTEL: 03-5511 2233\nTAX INVOICE\nInvoice No : CS 00031383\nINV NO.: 1187070\nDate : 12/03/2018 14:05\nSub Total 98.00\nGST total 5.88\nTotal (RM)\n1,103.88\nCash 1,200.00"
    f = spark.createDataFrame([(t,)], "t string").select(receipts.fields(F.col("t")).alias("f")).select("f.*").first()
    assert (f.vendor_name, f.invoice_date, f.amount, f.currency) == ("SYARIKAT HARDWARE SDN BHD (12345-X)", dt.date(2018, 3, 12), 1103.88, "MYR")
    for source, want in [("INV NO.: 1187070", "1187070"), ("Receipt No\n:\nCS00031383", "CS00031383"), ("NO: 1-1&2 JALAN\nBill No: V001- 515592", "V001-515592"), ("Invoice date: 12/03/2018\nOrder #: A77", "A77"), ("nothing", None)]:
        assert one(spark, source, receipts.invoice_number) == want
    assert one(spark, "just 12.50 and 9.00", lambda c: receipts.amount(receipts.lines_of(c))) == 12.5 and one(spark, "1.234", lambda c: receipts.amount(receipts.lines_of(c))) is None
    assert receipts.assembled([(50, 10, 10, "12.50"), (0, 12, 10, "TOTAL"), (0, 40, 10, "END")]) == "TOTAL 12.50\nEND"


def test_leave_one_out_statistics(spark):
    r = random.Random(3)
    rows, want = [], {}
    for v, n in enumerate([1, 2, 3, 4, 5, 8, 21, 40]):
        a = [round(r.choice([100.0, 100.0, r.lognormvariate(5, 1)]), 2) for _ in range(n)]
        for k, x in enumerate(a):
            i = len(rows) + 1
            rows.append((i, f"N{i}", f"V{v}", "x", "2024-01-01", x))
            others = a[:k] + a[k + 1 :]
            med = statistics.median(others) if others and n <= 20 else statistics.median(a) if n > 20 else None
            base = [np.log(max(y, 0.01)) for y in (others if n <= 20 else a)]
            lmed = statistics.median(base) if base else None
            lmad = statistics.median([abs(y - lmed) for y in base]) if base else None
            own = np.log(max(x, 0.01))
            z = 0.0 if lmad is None or (lmad == 0 and np.isclose(own, lmed)) else float(np.sign(own - lmed) * 50) if lmad == 0 else float(np.clip((own - lmed) / (1.4826 * lmad), -50, 50))
            want[i] = (n - 1.0, x / med if med else 1.0, z)
    got = stats.add_features(cleaning.clean(invoices(spark, rows)), Settings(leave_one_out_most=20)).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.vendor_history_count, g.amount_to_vendor_median, g.amount_robust_z) == pytest.approx(want[g.id], abs=1e-9)


def test_band_join_against_all_pairs(spark):
    r = random.Random(4)
    rows = []
    for i in range(1, 400):
        a = r.choice([-5.0, -2.0, -1.0, 0.0, 0.005, 1.0, 99.99, 100.0, 100.3, 100.5, 100.52, 5000.0]) * r.choice([1, 1.004, 1.005, 1.0051])
        rows.append((i, r.choice(["A1", "A-1", "B2"]), r.choice(["V1", "V2", "V3"]), r.choice(["Acme", "Acmo", "Zeta", "Ltd"]), f"2024-01-{r.randint(1, 25):02d}", a))
    found = {(x.i_id, x.j_id) for x in pairs.candidates(cleaning.clean(invoices(spark, rows))).collect()}
    want = set()
    names = {"Acme": "acme", "Acmo": "acmo", "Zeta": "zeta", "Ltd": "ltd"}
    for p, q in itertools.combinations(rows, 2):
        p, q = sorted((p, q), key=lambda x: (x[5], x[0]))
        close = q[5] <= p[5] * 1.005 + 0.01 and abs((dt.date.fromisoformat(p[4]) - dt.date.fromisoformat(q[4])).days) <= 7
        if close and (names[p[3]][:3] == names[q[3]][:3] or p[2] == q[2]) and not (p[1] == q[1] and p[2] == q[2]):
            want.add((p[0], q[0]))
    assert found == want and want


def test_rules_edges(spark):
    rows = [
        (1, "--", "V1", "a", "2024-01-01", 10.0), (2, "--", "V1", "a", "2024-03-01", 10.0),  # empty numbers still copy each other
        (3, "N3", "V2", "b", "2024-01-01", 10.0), (4, "N-3", "V2", "b", "2024-05-01", 11.0),  # re-billed
        (5, "N5", "V3", "c", "2024-01-01", 1.0), (6, "N5", "V3", "c", "2024-03-01", 2.0), (7, "N5", "V3", "c", "2024-06-01", 3.0),  # three uses: a terminal
        (8, "B1", "V4", "d", "2024-01-01", 1.0, "USD", "P"), (9, "B2", "V4", "d", "2024-01-01", 2.0, "USD", "P"), (10, "B3", "V4", "d", "2024-01-01", 4.0, "USD", "P"),
        (11, "C1", "V5", "e", "2024-01-01", 1.0), (12, "C2", "V5", "e", "2024-01-01", 2.0), (13, "C3", "V5", "e", "2024-01-01", 4.0),  # no order number: no burst
    ]
    got = {r.id: r.flags for r in audit.score(invoices(spark, rows)).rows.collect()}
    assert got == {i: {2: "exact_dup", 4: "same_number", 8: "rapid_fire", 9: "rapid_fire", 10: "rapid_fire"}.get(i, "none") for i in range(1, 14)}


def test_verdicts(spark):
    df = spark.createDataFrame([("HIGH", False), ("MEDIUM", False), ("LOW", True), ("LOW", None)], "c string, t boolean")
    assert [r.v for r in df.select(rules.verdict(F.col("c"), F.col("t")).alias("v")).collect()] == ["SUSPICIOUS", "REVIEW", "REVIEW", "OK"]


def test_vendor_resolution(spark):
    known = spark.createDataFrame([("V1", "Metro Print & Pack"), ("V2", "Home Master Hardware & Tailoring"), ("V3", "Acme Ltd")], "vendor_id string, vendor_name string")
    rows = spark.createDataFrame([("METRO PRINT & PACK LLC", None), ("Metro Prnt & Pack", None), ("Home Master Hardware &", None), ("Acme Bakery", None), ("Zenith", "OWN"), (None, None)], "vendor_name string, vendor_id string")
    got = {r.vendor_name: r.vendor_id for r in vendors.resolve_vendors(rows, known).collect()}
    assert got == {"METRO PRINT & PACK LLC": "V1", "Metro Prnt & Pack": "V1", "Home Master Hardware &": "V2", "Acme Bakery": "V-ACME-BAKERY", "Zenith": "OWN", None: "V-UNKNOWN"}
    near = {r.vendor_name: r.closest for r in vendors.closest_vendors(spark.createDataFrame([("Metro Prnt and Pack",), ("Qqq",)], "vendor_name string"), known).collect()}
    assert near == {"Metro Prnt and Pack": "Metro Print & Pack", "Qqq": None}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("records")))
    start = dt.date(2024, 1, 1)
    weekly = [(f"INV-{i:04d}", "Acme Supplies Ltd", (start + dt.timedelta(7 * i)).isoformat(), 1000.0 + 10 * (i % 5)) for i in range(60)]
    rows, problems = ingest.normalize(spark.createDataFrame([(a, b, c, str(d)) for a, b, c, d in weekly], "`Invoice No` string, Vendor string, Date string, Amount string"))
    assert not problems and s.import_records(rows) == 60 and s.import_records(rows) == 0
    return s


def test_check_end_to_end(spark, store):
    new = spark.createDataFrame([(a, b, c, str(d), *(e or [None])) for a, b, c, d, *e in [
        ("INV-0011", "Acme Supplies Ltd", "2024-03-18", 1010.0), ("INV0012", "ACME SUPPLIES", "2024-03-25", 1020.0), ("INV-9001", "Acme Supplies Ltd", "2025-03-03", 5000.0), ("INV-9002", "Acme Supplies Ltd", "2025-03-10", 1020.0),
        ("Q-1", "Quartz Rentals", "2025-03-01", 77.0), ("INV-0020", "Acme Supplies Ltd", "2024-05-20", 1070.0), ("INV 0030", "THE Acme Supplies", "2024-07-29", 1000.0), ("Q-1", "Quartz Rentals", "2025-03-01", 77.0), ("X-1", "Akme Suplies", "2025-03-02", 5.0, "XYZ"),
    ]], "invoice_id string, vendor_name string, invoice_date string, amount string, currency string")
    results, related = store.check(new)
    got = results.persist().collect()
    assert [r.id for r in got] == [-i for i in range(1, 10)]
    assert [r.verdict for r in got] == ["SUSPICIOUS", "SUSPICIOUS", "SUSPICIOUS", "OK", "OK", "REVIEW", "SUSPICIOUS", "SUSPICIOUS", "OK"]
    assert "exact_dup" in got[0].flags and got[2].flags == "overpayment" and got[5].flags == "same_number" and got[7].flags == "exact_dup"
    assert got[0].reasons.startswith("Exact duplicate of record #12: INV-0011, Acme Supplies Ltd, 2024-03-18, 1,010.00")
    assert got[3].reasons == "No issues found against existing records" and got[4].reasons == "New vendor: no payment history to compare against"
    assert "another invoice in this batch" in got[7].reasons and "Same invoice number as record #21, different amount" in got[5].reasons
    assert "Did you mean 'Acme Supplies Ltd'?" in got[8].reasons and "No exchange rate for XYZ" in got[8].reasons
    assert {r.new_id for r in related.collect()} == {-1, -2, -6, -7, -8}
    store.log_checks(results, "upload", "f.csv", checked_by="me")
    log = store.recent("receipt_checks", 200).collect()
    assert len(log) == 9 and {r.checked_by for r in log} == {"me"} and log[0].id == 9
    assert store.add_to_records(results.where("verdict = 'OK'")) == 3 and store.count_invoices() == 63


def test_audit_backup_and_merge(spark, store):
    before = store.count_invoices()
    name = store.backup()
    split = spark.createDataFrame([("Z-1", "V-ACME-OLD", "Acme Supplies (M)", dt.date(2025, 6, 1), 1000.0)], "invoice_id string, vendor_id string, vendor_name string, invoice_date date, amount double")
    assert store.import_records(split) == 1
    summary = store.audit()
    assert summary["vendor_ids_merged"] == 1 and summary["records"] == before + 1 and sum(summary.get(t, 0) for t in ("LOW", "MEDIUM", "HIGH")) == before + 1
    assert store.query("SELECT vendor_id FROM invoices WHERE invoice_id = :n", n="Z-1").first().vendor_id == "V-ACME-SUPPLIES"
    assert store.table("detection_results").count() == before + 1 and store.table("invoices").where("payment_status = 'pending'").count() == before + 1
    store.restore(name)
    assert store.count_invoices() == before


def test_empty_records(spark, tmp_path):
    assert Store(spark, str(tmp_path / "none")).audit() == {"records": 0}


def test_csv_and_rates(spark, tmp_path):
    df = spark.createDataFrame([("=HYPERLINK(1)", -5.0), ("@x", 1.0), ("ok", 2.0)], "vendor_name string, amount double")
    assert [(r[0], r[1]) for r in csv_escaped(df).collect()] == [("'=HYPERLINK(1)", -5.0), ("'@x", 1.0), ("ok", 2.0)]
    save_rates(spark.createDataFrame([(" eur ", 2.0), ("GBP", -1.0), (None, 3.0)], "currency string, usd_per_unit double"), str(tmp_path / "rates"))
    rates = {r[0]: r[1] for r in read_rates(spark, str(tmp_path / "rates")).collect()}
    assert rates["EUR"] == 2.0 and rates["GBP"] == 1.27 and rates["USD"] == 1.0


def test_evaluation(spark):
    df = spark.createDataFrame([(1, "a", "HIGH"), (1, "a", "LOW"), (0, None, "HIGH"), (None, None, "HIGH")], "is_anomaly int, anomaly_type string, risk_category string")
    r = audit.evaluate(df).first()
    assert (r.labelled, r.known_bad, r.flagged, r.precision, r.recall) == (3, 2, 2, 0.5, 0.5)
    assert [(x.anomaly_type, x.recall) for x in audit.recall_by_type(df).collect()] == [("a", 0.5)]
    assert tuple(audit.evaluate(df.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)


def test_numbering_follows_input(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") * 3).alias("x"))
    assert [r.n for r in check.numbered(df, "n", -1, -1).orderBy("x").collect()] == [-1 - i for i in range(1000)]


def test_stream_checks_each_batch_once(spark, store, tmp_path):
    from tallyforge.streaming.check_stream import check_stream

    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("INV-0040", "Acme Supplies Ltd", dt.date(2024, 10, 7), 1000.0)], "invoice_id string, vendor_name string, invoice_date date, amount double")
    rows.write.parquet(source)
    before = store.table("receipt_checks").count()
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        check_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
    log = store.table("receipt_checks").where("source like 'stream%'").collect()
    assert len(log) == 1 and log[0].verdict == "SUSPICIOUS" and store.table("receipt_checks").count() == before + 1


def test_command_line(spark, tmp_path, capsys):
    from tallyforge.cli import main

    (tmp_path / "a.csv").write_text('Invoice Number,Vendor Name,Invoice Date,Amount,Currency\n7781,Globex Corporation,2024-02-20,860.00,EUR\n"7782","Globex, Inc",2024-03-20,861.00,EUR\n')
    at = str(tmp_path / "s")
    assert main([at, "import", str(tmp_path / "a.csv"), "--monthfirst"], spark) == 0 and "2 new records" in capsys.readouterr().out
    assert main([at, "check", str(tmp_path / "a.csv"), "--out", str(tmp_path / "out")], spark) == 0 and "SUSPICIOUS: 2" in capsys.readouterr().out
    assert main([at, "audit"], spark) == 0 and '"records": 2' in capsys.readouterr().out
    assert main([at, "backup"], spark) == 0


def jpeg_bytes(quality):
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = bytes(int(x) for x in np.clip((np.array(images.LUMA, np.int64) * scale + 50) // 100, 1, 255))
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xdb" + struct.pack(">H", 67) + b"\x00" + table + b"\xff\xda\x00\x02"


def test_jpeg_quality(spark):
    assert [images.jpeg_quality(jpeg_bytes(q)) for q in (30, 75, 85, 92)] == [30, 75, 85, 92] and images.jpeg_quality(b"\x89PNG") is None
    assert "quality 75" in images.cannot_assess(jpeg_bytes(75)) and images.cannot_assess(jpeg_bytes(92)) is None
    files = spark.createDataFrame([("a", bytearray(jpeg_bytes(40))), ("b", bytearray(b"x"))], "path string, content binary")
    assert {r.path: r.quality for r in tamper.assessments(files).collect()} == {"a": 40, "b": None}


def test_block_features_and_regions(spark):
    r = np.random.default_rng(5)
    grey = np.full((96, 128), 250.0)
    grey[32:64, 32:64] = r.integers(0, 255, (32, 32))
    rows = images.block_features(grey, lambda q: grey - (100 - q))
    assert [(x["by"], x["bx"]) for x in rows] == [(1, 1)] and rows[0]["ela75_mean"] == 25 and rows[0]["ela90_std"] == 0 and rows[0]["ink_share"] == pytest.approx(1 / 12)
    assert set(tamper.FEATURES) | {"bx", "by"} == set(rows[0]) and len(tamper.FEATURES) == 52
    assert images.block_features(np.zeros((10, 10)), lambda q: np.zeros((10, 10))) == []
    blocks = spark.createDataFrame([("a", 1, 1), ("a", 3, 3)], "path string, by int, bx int")
    regions = spark.createDataFrame([("a", 40, 40, 5, 5)], "path string, x int, y int, width int, height int")
    assert {(x.by, x.label) for x in tamper.edited(blocks, regions).collect()} == {(1, 1.0), (3, 0.0)}
    top = tamper.by_image(blocks.withColumn("p", F.col("bx") / 10), F.col("p")).first()
    assert (top.score, top.by) == (0.3, 3)
    assert tamper.best_threshold(spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.2, 0)], "score double, label int")) == 0.8


def _bills(spark, *numbers, vendor="Acme Tools"):
    return spark.createDataFrame([(n, vendor, dt.date(2024, 1, 1 + i % 28), 100.0 + i, "USD") for i, n in enumerate(numbers)], "invoice_id string, vendor_name string, invoice_date date, amount double, currency string")


def test_two_writers_lose_nothing(spark, tmp_path):
    """Both writers read the same state; the second to commit starts again from the first one's."""
    one, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    one.import_records(_bills(spark, "A1", "A2"))
    real, waited = one._commit, []

    def late(change, based_on=None):
        if not waited:
            waited.append(other.import_records(_bills(spark, "B1", "B2", "B3", vendor="Bolt Works")))
            other.append("receipt_checks", spark.createDataFrame([(1, "x")], "id long, source string"))
        return real(change, based_on)

    one._commit = late
    assert one.import_records(_bills(spark, "C1", vendor="Crane Hire")) == 1 and waited == [3]
    rows = one.table("invoices").collect()
    assert sorted(r.invoice_id for r in rows) == ["A1", "A2", "B1", "B2", "B3", "C1"] and len({r.id for r in rows}) == 6
    assert one.table("vendors").count() == 3 and one.table("receipt_checks").count() == 1
    before = one._state()
    one._write = lambda *a: (_ for _ in ()).throw(OSError("stopped"))
    with pytest.raises(OSError):
        one.import_records(_bills(spark, "D1"))
    assert other._state() == before and other.count_invoices() == 6


def test_states_are_whole_and_vacuum_waits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.import_records(_bills(spark, "A1"))
    assert not store._write(store._names("state-")[-1], "{}") and store.count_invoices() == 1
    store.replace(invoices=store.table("invoices").withColumn("amount", F.lit(5.0)), vendors=store.table("vendors"))
    store._new_part("invoices", _bills(spark, "Z"))
    assert store.vacuum() == 0 and store.vacuum(0) == 3 and [r.amount for r in store.table("invoices").collect()] == [5.0]
    for i in range(25):
        store.append("receipt_checks", spark.createDataFrame([(i, "x")], "id long, source string"))
    assert len(store._names("state-")) == 21 and store.table("receipt_checks").count() == 25


def test_batches_are_logged_and_added_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.import_records(_bills(spark, "A1"))
    results, _ = store.check(_bills(spark, "B1", "B2", vendor="Bolt's Works"))
    results = results.cache()
    real = store._commit
    store._commit = lambda *a, **k: (_ for _ in ()).throw(OSError("stopped"))
    with pytest.raises(OSError):
        store.log_batch(results, "it's #1", results)
    store._commit = real
    assert store.count_invoices() == 1 and store.table("receipt_checks").count() == 0
    assert store.log_batch(results, "it's #1", results) and not store.log_batch(results, "it's #1", results)
    assert store.count_invoices() == 3 and store.table("receipt_checks").count() == 2
    with pytest.raises(ValueError):
        store.add_to_records(results.withColumn("verdict", F.lit("SUSPICIOUS")))


def test_numbered_over_many_partitions(spark):
    rows = spark.range(1000).repartition(37, "id")
    got = check.numbered(rows, "n", -1, -1).collect()
    assert sorted(r.n for r in got) == list(range(-1000, 0)) and check.numbered(rows.limit(0), "n").count() == 0


def test_receipt_files_and_boxes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ACME TRADING\nInvoice No: A-77\nDate: 2024-03-01\nTotal $ 12.50")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "d.bin").write_bytes(b"\xff\xfe\xfa")
    files = receipt_files.read_files(spark, str(tmp_path))
    boxes = lambda data: [(50.0, 10.0, 10.0, "9.99"), (0.0, 12.0, 10.0, "TOTAL")]
    got = {r.path[-5:]: r for r in receipt_files.file_fields(files, from_pdf=lambda data: "", from_image=boxes).collect()}
    assert (got["a.txt"].vendor_name, got["a.txt"].invoice_id, got["a.txt"].amount, got["a.txt"].currency, got["a.txt"].problem) == ("ACME TRADING", "A-77", 12.5, "USD", None)
    assert "scans" in got["b.pdf"].problem and got["c.jpg"].amount == 9.99 and got["d.bin"].problem and got["d.bin"].amount is None
    rows = spark.createDataFrame([("p", 50.0, 10.0, 10.0, "12.50"), ("p", 0.0, 12.0, 10.0, "TOTAL"), ("p", 0.0, 40.0, 10.0, "END"), ("q", 1.0, 1.0, 1.0, "x")], "path string, left double, middle double, height double, text string")
    assert {r.path: r.text for r in receipt_files.box_lines(rows).collect()} == {"p": "TOTAL 12.50\nEND", "q": "x"}


def test_image_verdicts_and_report(spark):
    told = spark.createDataFrame([("a", 95, None), ("b", None, None), ("c", 50, "not checked: strong"), ("d", None, None)], "path string, quality int, reason string")
    scores = spark.createDataFrame([("a", 0.96, 2, 3), ("b", 0.96, 0, 0)], "path string, score double, by int, bx int")
    got = {r.path: r for r in tamper.image_verdicts(told, scores, {"scan": 0.95, "jpeg": 0.97}).collect()}
    assert (got["a"].suspicious, got["a"].x, got["a"].y, got["a"].width) == (False, 96, 64, 32) and got["b"].suspicious and got["c"].reason.endswith("strong") and "no ink" in got["d"].reason and got["d"].score is None
    r = random.Random(9)
    rows = [(round(r.random(), 1), int(r.random() < 0.3)) for _ in range(200)]
    m = tamper.report(spark.createDataFrame(rows, "score double, label int"), 0.6).first()
    bad, good = [s for s, y in rows if y], [s for s, y in rows if not y]
    hits, flagged = sum(s >= 0.6 for s in bad), sum(s >= 0.6 for s, _ in rows)
    assert abs(m.roc_auc - sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good))) < 1e-12
    assert (m.images, m.edited, m.precision, m.recall, m.f1) == (200, len(bad), hits / flagged, hits / len(bad), 2 * hits / (flagged + len(bad)))
    labelled = spark.createDataFrame([(f"p{i}", float(i < 10)) for i in range(40) for _ in range(3)], "path string, label double")
    folds = tamper.folds_of(labelled, 5).groupBy("fold").count().collect()
    assert sorted(x["count"] for x in folds) == [8] * 5


def test_many_names_are_searched_at_once(spark, monkeypatch):
    """closest_vendor, vendor_resolve_fuzzy and reasons_text rest on this search: its results are brute force's, words that
    come again included, and names reach Python in blocks instead of once for each block of known ones."""
    import random

    from tallyforge.functions import similarity
    from tallyforge.operators import vendors

    known = ["ke ke", "miba kebakemi sons mike mi", "bababalo supplies", "babalo logistics"]
    assert similarity.Choices(known).search(["miba & co\x1cop bake"], "weight", [0.7]) == [(similarity.weighted_ratio(known[0], "miba & co\x1cop bake"), 0)]
    r = random.Random(1)
    words = ["ba", "ke", "lo", "supplies", "trading", "the", "sons", "&"]
    make = lambda: " ".join(r.choice(words) + r.choice(["", "mi", "x"]) for _ in range(r.randint(1, 5)))
    names, held = sorted({make() for _ in range(60)}), sorted({make() for _ in range(90)})
    monkeypatch.setattr(vendors, "BLOCK", 25)
    table = spark.createDataFrame([(n, i) for i, n in enumerate(held)], "clean string, ord int")
    rows = spark.createDataFrame([(n,) for n in names], "clean string")
    found = vendors.best_matches(rows, table, "suggest")
    got = {x.clean: x.found for x in found.collect()}
    for n in names:
        scores = [similarity.weighted_ratio(n, x) for x in held]
        assert got[n] == (held[scores.index(max(scores))] if max(scores) >= 0.7 else None)
    got = {x.clean: x.found for x in vendors.best_matches(rows, table, "resolve").collect()}
    for n in names:
        scores = [similarity.ratio(n, x) for x in held]
        parts = [similarity.partial_ratio(n, x) if min(len(n), len(x)) >= 15 else 0 for x in held]
        assert got[n] == (held[scores.index(max(scores))] if max(scores) >= 0.9 else held[parts.index(max(parts))] if max(parts) >= 0.95 else None)
