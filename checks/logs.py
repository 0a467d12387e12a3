"""S2, S4, S5, S8, K1-K7, A3, A4, A10, A14, L1, J13, W6, W9, W10, F9-F17, F24-F26, F28, P7, P9, X2-X4, T1-T5."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from checks.corpus import CORPUS, _sql, corpus, docs, table
from checks.policies import ALL, OPTIONS
from checks.registry import query
from codesieve import fixed_values as fv
from codesieve.functions import text
from codesieve.operators import audit as au
from codesieve.operators import enrich, fixes, limiter, options, reports, review, selection
from codesieve.plans.scan import scan, verdicts
from codesieve.session import checkpoint_folder
from codesieve.sources import audit_log as stored
from codesieve.sources import readers, writers
from codesieve.streaming import batches, jobs

NL = "chr(10)"


def scratch(spark) -> str:
    """A new folder: on the shared storage the cluster names, else, on a local master only, a temporary one."""
    shared = checkpoint_folder(spark)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="scan-")


def stored_findings(files, folder):
    """Findings of one scan, written once for the reports that follow."""
    found = scan(files, options=OPTIONS)
    found.write.parquet(folder + "/found")
    return files.sparkSession.read.schema(found.schema).parquet(folder + "/found")


# --- audit log derived from events ---------------------------------------------------------
# click events are resolutions; error, purchase and signup, view are blocking, warning, advisory
_AUDIT = """audit AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp, ts,
  CASE WHEN event_type = 'click' THEN 'a' || (event_id // 2) ELSE 'a' || event_id END AS audit_id,
  CASE WHEN event_type = 'click' THEN 'resolution' END AS event,
  CASE WHEN event_type = 'click' THEN CASE event_id % 2 WHEN 0 THEN 'accepted' ELSE 'rejected' END ELSE 'unresolved' END AS resolution,
  CASE WHEN event_type = 'click' THEN 'u' || user_id END AS actor,
  CASE event_type WHEN 'error' THEN 'blocking' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'advisory' END AS policy,
  event_type = 'error' AND user_id % 2 = 0 AS override_allowed,
  CASE WHEN event_type = 'click' THEN 'none' WHEN user_id % 7 = 0 THEN 'counts' WHEN user_id % 5 = 0 THEN 'batch' ELSE 'single' END AS kind,
  event_id % 4 AS n FROM events)"""


def audit_log(spark, sf):
    e = table(spark, sf, "events")
    k, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    click = kind == "click"
    n = (k % 4).cast("int")
    item = F.struct(
        F.lit("hardcoded_secret").alias("type"), F.lit("m").alias("message"), F.lit("blocking").alias("severity"),
        F.lit("blocking").alias("policy_level"), F.lit(1).alias("line"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    none = F.lit(None).cast("array<struct<type:string,message:string,severity:string,policy_level:string,line:int,start:int,end:int>>")

    def arrays(size, on):
        return [F.when(on, F.array_repeat(item, size + shift)).otherwise(none).alias(name)
                for shift, name in enumerate(["issues", "coding_issues", "license_ip_issues", "sector_issues", "ai_suggestions"])] + [
                    none.alias("repo_license_issues")]

    per_file = F.struct(*arrays(n, F.lit(True)))
    counts_only, nested = u % 7 == 0, u % 5 == 0
    single = ~counts_only & ~nested
    plain = arrays(n, single)
    plain[5] = F.when(~counts_only, F.array_repeat(item, n)).otherwise(none).alias("repo_license_issues")
    output = F.struct(
        *plain, F.when(~counts_only & nested, F.create_map(F.lit("a"), per_file, F.lit("b"), per_file)).alias("findings"),
        F.when(counts_only, F.struct(*[n.alias(c) for _, _, c in fv.FAMILIES])).alias("counts"))
    return e.select(
        k.alias("seq"), au.iso_utc(F.col("ts")).alias("timestamp"), "ts",
        F.concat(F.lit("a"), F.when(click, F.floor(k / 2)).otherwise(k).cast("string")).alias("audit_id"),
        F.when(click, "resolution").alias("event"),
        F.when(click, F.when(k % 2 == 0, "accepted").otherwise("rejected")).otherwise("unresolved").alias("resolution"),
        F.when(click, F.concat(F.lit("u"), u.cast("string"))).alias("actor"),
        F.when(kind == "error", "blocking").when(kind.isin("purchase", "signup"), "warning").when(kind == "view", "advisory").alias("policy"),
        ((kind == "error") & (u % 2 == 0)).alias("override_allowed"),
        F.when(~click, output).alias("output"))


_LEVELS = ", ".join(f"count(*) FILTER (coalesce(policy, 'advisory') = '{level}') AS {level}" for level in fv.LEVELS)


@query("A3_summary_faithful", f"""WITH {_AUDIT} SELECT count(*) AS total_requests, {_LEVELS},
  {', '.join(f"CAST(coalesce(sum(CASE WHEN kind = 'single' THEN n + {i} ELSE 0 END), 0) AS BIGINT) AS {c}" for i, c in enumerate(['issues', 'coding', 'license_ip', 'sector', 'ai']))},
  CAST(coalesce(sum(CASE WHEN kind IN ('single', 'batch') THEN n ELSE 0 END), 0) AS BIGINT) AS repo_license FROM audit""")
def _a3(spark, sf):
    return reports.summary(audit_log(spark, sf), faithful=True)


@query("A3_summary", f"""WITH {_AUDIT} SELECT count(*) AS total_requests, {_LEVELS},
  {', '.join(f"CAST(sum(CASE kind WHEN 'single' THEN n + {i} WHEN 'batch' THEN 2 * (n + {i}) ELSE n END) AS BIGINT) AS {c}" for i, c in enumerate(['issues', 'coding', 'license_ip', 'sector', 'ai']))},
  CAST(sum(n) AS BIGINT) AS repo_license FROM audit WHERE event IS NULL""")
def _a3b(spark, sf):
    return reports.summary(audit_log(spark, sf))


@query("A4_F9_trends", f"WITH {_AUDIT} SELECT substr(timestamp, 1, 10) AS day, {_LEVELS} FROM audit GROUP BY day")
def _a4(spark, sf):
    return reports.trends(audit_log(spark, sf))


@query("A10_total_analyses", "SELECT count(*) AS total_analyses FROM events")
def _a10(spark, sf):
    return reports.total_analyses(audit_log(spark, sf))


@query("A14_issue_counts", f"WITH {_AUDIT} SELECT seq, CASE WHEN kind = 'single' THEN n ELSE 0 END AS issue_count FROM audit")
def _a14(spark, sf):
    return reports.issue_counts(audit_log(spark, sf))


@query("L1_recent", f"""WITH {_AUDIT} SELECT seq, timestamp, upper(substr(coalesce(policy, ''), 1, 1)) || substr(coalesce(policy, ''), 2) AS policy,
  CASE WHEN kind = 'single' THEN n ELSE 0 END AS issue_count, CASE WHEN override_allowed THEN 'Yes' ELSE 'No' END AS override_allowed FROM audit ORDER BY seq DESC LIMIT 100""")
def _l1(spark, sf):
    return reports.recent(audit_log(spark, sf), fv.DASHBOARD_ROWS)


@query("J13_latest_resolution", f"""WITH {_AUDIT}, r AS (SELECT audit_id, arg_max({{'r': resolution, 'a': actor}}, seq) AS last FROM audit WHERE event IS NOT NULL GROUP BY ALL)
 SELECT a.audit_id, coalesce(last.r, a.resolution) AS resolution, last.a AS actor FROM audit a LEFT JOIN r ON a.audit_id = r.audit_id WHERE event IS NULL""")
def _j13(spark, sf):
    return au.latest_resolution(audit_log(spark, sf)).select("audit_id", "resolution", "actor")


@query("K3_resolution_rows", f"""WITH {_AUDIT} SELECT audit_id, resolution, actor, 'resolution' AS event FROM audit WHERE actor IS NOT NULL AND seq % 3 > 0""")
def _k3(spark, sf):
    asked = audit_log(spark, sf).where("actor is not null").select(
        F.when(F.col("seq") % 3 > 0, F.col("audit_id")).otherwise("").alias("audit_id"), "resolution", "actor")
    return au.resolution_rows(asked)


@query("K4_W10_retention", """WITH e AS (SELECT event_id AS seq, sum(length(props) + 100) OVER (ORDER BY event_id DESC) AS running FROM events)
 SELECT seq, CAST(running AS BIGINT) AS running, CAST((running - 1) // 50000 AS BIGINT) AS segment_no FROM e WHERE running <= 300000""")
def _k4(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "props")
    return au.retained(e, F.length("props") + 100, 50000, 5).select("seq", "running", "segment_no")


@query("K7_S5_export_round_trip", f"""WITH {_AUDIT} SELECT timestamp, audit_id, event, resolution, actor, policy, CASE WHEN kind = 'single' THEN n ELSE 0 END AS issues FROM audit""")
def _k7(spark, sf):
    folder = scratch(spark)
    writers.export_audit(audit_log(spark, sf).drop("seq", "ts"), folder + "/log")
    back = readers.read_audit(spark, folder + "/log")
    return back.select("timestamp", "audit_id", "event", "resolution", "actor", "policy",
                       F.coalesce(F.when(F.col("output.issues").isNotNull(), F.size("output.issues")), F.lit(0)).cast("bigint").alias("issues"))


# --- hash chain --------------------------------------------------------------------------
KEY = b"check key"
_INNER = "".join(f"\\x{b ^ 0x36:02X}" for b in KEY.ljust(64, b"\0"))
_OUTER = "".join(f"\\x{b ^ 0x5C:02X}" for b in KEY.ljust(64, b"\0"))


@query("F11_hmac", f"SELECT doc_id, sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(text)))) AS mac FROM documents")
def _f11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.hmac_sha256(KEY, F.col("text")).alias("mac"))


@query("X3_canonical_json", """SELECT event_id, '{"event": "' || event_type || '", "id": ' || event_id || ', "prev_hash": null, "user": ' || user_id || '}' AS body FROM events""")
def _x3(spark, sf):
    e = table(spark, sf, "events")
    entry = F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("event"), F.col("event_id").alias("id")))
    return e.select("event_id", au.canonical_json(entry, F.lit(None).cast("string")).alias("body"))


@query("W6_hash_chain", """SELECT event_id AS seq, event_id // 1000 AS segment, event_id % 97 <> 13 AS hash_ok,
  NOT (event_id % 89 = 7 AND event_id % 1000 > 0) AS link_ok FROM events""")
def _w6(spark, sf):
    """Chain all events, tamper with some rows, verify: exactly those rows must fail."""
    e = table(spark, sf, "events")
    entry = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    rows = e.select(F.floor(F.col("event_id") / 1000).alias("segment"), F.col("event_id").alias("seq"), entry.alias("entry"))
    folder = scratch(spark)
    au.write_chain(rows, KEY).write.parquet(folder + "/chain")
    log = spark.read.parquet(folder + "/chain")
    altered = F.replace("entry", F.lit('"event_id"'), F.lit('"event_no"'))
    forged = log.withColumn("entry", F.when(F.col("seq") % 97 == 13, altered).otherwise(F.col("entry")))
    checked = au.verify_chain(forged, KEY)
    # a cut link: rows whose predecessor is claimed to have another hash
    prior = log.select("segment", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("h"))
    cut = log.join(prior, ["segment", "seq"], "left").select("segment", "seq", F.when(
        F.col("seq") % 89 == 7, F.concat(F.col("h"), F.lit("x"))).otherwise(F.col("h")).alias("h"), "prev_hash")
    links = cut.select("segment", "seq", F.col("prev_hash").eqNullSafe(F.col("h")).alias("cut_ok"))
    return checked.join(links, ["segment", "seq"]).select("seq", "segment", "hash_ok", (F.col("link_ok") & F.col("cut_ok")).alias("link_ok"))


# --- limiter -----------------------------------------------------------------------------


def _requests(spark, sf, clients=3):
    return table(spark, sf, "events").select((F.col("user_id") % clients).alias("client"), "ts", F.col("event_id").alias("id"))


@query("W9_window_counts", """SELECT event_id AS id, count(*) OVER (PARTITION BY user_id % 3 ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def _w9(spark, sf):
    return limiter.window_counts(_requests(spark, sf), 3600).select("id", "in_window")


# Admission depends on earlier admissions: a recursion over the requests of each client.
_ADMITTED = """WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS client, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r(client, rn, id, taken, ok) AS (
  SELECT client, rn, id, [us], true FROM e WHERE rn = 1
  UNION ALL SELECT e.client, e.rn, e.id, CASE WHEN len(list_filter(taken, lambda t: us - t < 86400000000)) < 2
     THEN list_append(list_filter(taken, lambda t: us - t < 86400000000), us) ELSE list_filter(taken, lambda t: us - t < 86400000000) END,
    len(list_filter(taken, lambda t: us - t < 86400000000)) < 2 FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1)
 SELECT id, ok AS admitted FROM r"""


@query("T3_admissions", _ADMITTED)
def _t3(spark, sf):
    requests = table(spark, sf, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id"))
    return limiter.admissions(requests, 86400, 2).select("id", "admitted")


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drain(spark, stream, mode_path=None):
    folder = mode_path or scratch(spark)
    q = jobs.append_files(stream, folder + "/out", folder + "/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(folder + "/out")


@query("T3_admission_stream", _ADMITTED)
def _t3s(spark, sf):
    requests = _event_stream(spark, sf).select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id"))
    return _drain(spark, jobs.admission_stream(requests, 86400, 2)).select("id", "admitted")


@query("T2_audit_trend_stream", """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'error' THEN 'blocking' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'warning' ELSE 'advisory' END AS policy FROM events)
 SELECT day, count(*) FILTER (policy = 'advisory') AS advisory, count(*) FILTER (policy = 'warning') AS warning, count(*) FILTER (policy = 'blocking') AS blocking
 FROM d WHERE day < (SELECT strftime(max(ts) - INTERVAL 1 HOUR, '%Y-%m-%d') FROM events) GROUP BY day""")
def _t2(spark, sf):
    kind = F.col("event_type")
    rows = _event_stream(spark, sf).select("ts", F.when(kind == "error", "blocking").when(kind.isin("purchase", "signup"), "warning").otherwise("advisory").alias("policy"))
    return _drain(spark, jobs.audit_trends(rows, "1 hour"))


@query("T4_new_comment_stream", "SELECT DISTINCT user_id AS batch_id, event_type AS path, CAST(event_id % 5 AS INTEGER) AS line FROM events")
def _t4(spark, sf):
    rows = _event_stream(spark, sf).select(
        "ts", F.col("user_id").alias("batch_id"), F.col("event_type").alias("path"), (F.col("event_id") % 5).cast("int").alias("line"), F.lit("b").alias("body"))
    return _drain(spark, jobs.new_comments(rows, "60 days")).select("batch_id", "path", "line")


@query("T5_audit_append_stream", """SELECT 'a' || event_id AS audit_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp, event_type AS policy, '<redacted>' AS code FROM events""")
def _t5(spark, sf):
    rows = _event_stream(spark, sf).select("ts", F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("audit_id"), F.col("event_type").alias("policy"))
    return _drain(spark, jobs.audit_stream(rows)).select("audit_id", "timestamp", "policy", "code")


@query("T1_scan_stream", f"WITH {ALL} SELECT batch_id, CASE max(CASE policy WHEN 'blocking' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning' ELSE 'advisory' END AS policy, count(*) AS files_scanned FROM verdict GROUP BY batch_id")
def _t1(spark, sf):
    folder = scratch(spark)
    corpus(spark, sf).write.parquet(folder + "/in")
    stream = spark.readStream.schema("batch_id string, file_ord bigint, path string, code string").parquet(folder + "/in")
    q = jobs.scan_stream(stream, folder + "/findings", folder + "/verdicts", folder + "/checkpoint", OPTIONS, folder + "/audit")
    q.awaitTermination()
    return spark.read.parquet(folder + "/verdicts").select("batch_id", "policy", "files_scanned")


@query("T1_split_batches_stream", f"WITH {ALL} SELECT batch_id, CASE max(CASE policy WHEN 'blocking' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning' ELSE 'advisory' END AS policy, count(*) AS files_scanned, true AS complete FROM verdict GROUP BY batch_id")
def _t1_split(spark, sf):
    """Files of every batch arrive over several micro-batches; each batch is scanned once, when all its files are there."""
    folder, files = scratch(spark), corpus(spark, sf)
    sizes = files.groupBy("batch_id").agg(F.count("*").alias("n_files"))
    timed = files.join(sizes, "batch_id").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("file_ord") % 3))
    timed.write.parquet(folder + "/in")
    schema = "batch_id string, file_ord bigint, path string, code string, n_files bigint, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(folder + "/in")
    batches.store_files(stream, folder + "/stored", folder + "/check1").awaitTermination()
    batches.scan_ended_batches(spark, folder + "/stored", schema, folder + "/findings", folder + "/verdicts", folder + "/check2", OPTIONS).awaitTermination()
    return spark.read.parquet(folder + "/verdicts/verdicts").select("batch_id", "policy", "files_scanned", "complete")


# --- audit rows and scan report ------------------------------------------------------------


@query("K2_audit_rows", f"""WITH {ALL} SELECT batch_id AS request_id, '<redacted>' AS code, CASE max(r) WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning' ELSE 'advisory' END AS policy,
  count(*) AS files_scanned, (SELECT count(*) FROM f WHERE f.batch_id = rank.batch_id AND family = 'issues') AS issues,
  (SELECT count(*) FROM f WHERE f.batch_id = rank.batch_id AND family = 'license_ip') AS license_ip FROM rank GROUP BY batch_id""")
def _k2(spark, sf):
    files, folder = corpus(spark, sf), scratch(spark)
    found = stored_findings(files, folder)
    batches = files.select("batch_id").distinct()
    writers.append_audit(au.audit_rows(batches, verdicts(files, found)[1], found), folder)
    rows = readers.read_audit(spark, folder)
    return rows.select("request_id", F.get_json_object("input", "$.code").alias("code"), "policy", F.col("output.files_scanned").alias("files_scanned"),
                       F.col("output.counts.issues").alias("issues"), F.col("output.counts.license_ip").alias("license_ip"))


def _two_appends(spark, sf):
    """Scan, append the verdicts of half the batches and resolutions of some, then the same for the other half; the folder of the log."""
    files, folder = corpus(spark, sf), scratch(spark)
    found = stored_findings(files, folder)
    rows = au.audit_rows(files.select("batch_id").distinct(), verdicts(files, found)[1], found)
    number = F.regexp_replace("request_id", "src", "").cast("int")
    for part in (0, 1):
        writers.append_audit(rows.where(number % 2 == part), folder + "/audit", key=KEY)
        done = readers.read_audit(spark, folder + "/audit").where((F.col("event").isNull()) & (number % 2 == part) & (number % 3 > 0))
        for answer in ("accepted", "rejected"):  # the later one counts
            asked = done.where((number % 3 == 1) | F.lit(answer == "accepted")).select("audit_id", F.lit(answer).alias("resolution"), F.concat(F.lit("u"), "request_id").alias("actor"))
            writers.append_resolution(asked, folder + "/audit", KEY)
    return folder + "/audit"


_STORED = f"""{ALL}, bv AS (SELECT batch_id, CAST(replace(batch_id, 'src', '') AS INTEGER) AS n, CASE max(r) WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning' ELSE 'advisory' END AS policy FROM rank GROUP BY batch_id)"""


@query("K2_K3_J13_W6_stored_log", f"""WITH {_STORED} SELECT batch_id AS request_id, policy, CASE WHEN n % 3 = 0 THEN 'unresolved' WHEN n % 3 = 1 THEN 'rejected' ELSE 'accepted' END AS resolution,
  CASE WHEN n % 3 > 0 THEN 'u' || batch_id END AS actor, CAST(n % 2 * 3 AS BIGINT) AS epoch, true AS signed, true AS linked FROM bv""")
def _stored_log(spark, sf):
    """The stored log after six appends: newest resolution and chain of every batch's row."""
    folder = _two_appends(spark, sf)
    rows = au.latest_resolution(readers.read_audit(spark, folder))
    checked = stored.verify(spark, folder, KEY).select("seq", "hash_ok", "link_ok")
    return rows.join(checked, "seq").select("request_id", "policy", "resolution", "actor", F.floor(F.col("seq") / stored.EPOCH_ROWS).alias("epoch"),
                                            F.col("hash_ok").alias("signed"), F.col("link_ok").alias("linked"))


@query("A3_S5_summary_of_stored_log", f"""WITH {_STORED}, fam AS (SELECT family, count(*) AS n FROM f GROUP BY family)
 SELECT count(*) AS total_requests, count(*) FILTER (policy = 'advisory') AS advisory, count(*) FILTER (policy = 'warning') AS warning, count(*) FILTER (policy = 'blocking') AS blocking,
  {', '.join(f"CAST(coalesce((SELECT n FROM fam WHERE family = '{family}'), 0) AS BIGINT) AS {counter}" for family, _, counter in fv.FAMILIES)} FROM bv""")
def _stored_summary(spark, sf):
    return reports.summary(readers.read_audit(spark, _two_appends(spark, sf)))


@query("K1_scan_report", f"""WITH {ALL} SELECT files.batch_id, files.path, count(f.type) FILTER (family = 'issues') AS issues, count(f.type) FILTER (family = 'coding') AS coding
 FROM files LEFT JOIN f ON files.path = f.path GROUP BY ALL""")
def _k1(spark, sf):
    files, folder = corpus(spark, sf), scratch(spark)
    found = stored_findings(files, folder)
    nested = enrich.nest_findings(files, found)
    writers.write_scan_report(nested, verdicts(files, found)[1], folder)
    back = spark.read.schema("batch_id string, path string, issues array<struct<type:string>>, coding_issues array<struct<type:string>>").json(folder + "/files")
    return back.select("batch_id", "path", F.size("issues").cast("bigint").alias("issues"), F.size("coding_issues").cast("bigint").alias("coding"))


@query("S2_batch_requests", f"WITH {CORPUS} SELECT path, length(code) AS size FROM files")
def _s2(spark, sf):
    """Requests of at most 25 files each, written as JSON and read back."""
    files, folder = corpus(spark, sf), scratch(spark)
    chunked = files.join(selection.chunk_numbers(files), ["batch_id", "file_ord"])
    requests = chunked.groupBy(F.concat_ws("-", "batch_id", "chunk").alias("batch_id")).agg(
        F.sort_array(F.collect_list(F.struct("file_ord", "path", "code"))).alias("files"))
    requests.withColumn("files", F.transform("files", lambda f: f.dropFields("file_ord"))).write.json(folder + "/requests")
    back = readers.request_files(readers.read_requests(spark, folder + "/requests"))
    return back.select("path", F.length("code").cast("bigint").alias("size"))


@query("K6_S10_L6_rulepacks", "SELECT DISTINCT 'pack_' || lang AS pack, count(DISTINCT source) OVER (PARTITION BY lang) AS n_rules FROM (SELECT DISTINCT lang, source FROM documents)")
def _k6(spark, sf):
    from pyspark.sql.types import StructType

    from codesieve.rules import RULE_SCHEMA

    folder = scratch(spark) + "/rules"
    rules = table(spark, sf, "documents").select("lang", "source").distinct()
    for lang in [r.lang for r in rules.select("lang").distinct().collect()]:
        kinds = StructType.fromDDL(RULE_SCHEMA)
        one = rules.where(F.col("lang") == lang).select(
            F.col("source").alias("rule_id"),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds if f.name not in ("rule_id", "pack")])
        writers.upsert_rulepack(one.limit(1), folder, f"pack_{lang}")  # replaced by the next write
        writers.upsert_rulepack(one, folder, f"pack_{lang}")
    stored = readers.read_rulepacks(spark, folder)
    names = readers.list_rulepacks(stored)
    return names.join(stored.groupBy("pack").agg(F.count("*").alias("n_rules")), "pack")


_CONF = """c AS (SELECT DISTINCT source, CAST(replace(source, 'src', '') AS INTEGER) AS n FROM documents)"""


@query("S4_U3_L7_config_overlay", f"""WITH {_CONF} SELECT source AS repo, CASE WHEN n % 3 = 2 THEN 'finance' WHEN n % 3 = 0 AND n % 2 = 0 THEN 'json' ELSE 'yml' END AS sector,
  CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN 'warning' ELSE 'advisory' END AS own_level, 'blocking' AS org_level FROM c""")
def _s4(spark, sf):
    n = F.regexp_replace("source", "src", "").cast("int")
    repos = table(spark, sf, "documents").select("source").distinct()
    own_json = F.lit('{"sector": "json", "policy": {"b": "warning"}}')
    own_yml = F.when(n % 3 == 2, '{"policy": {"b": "advisory"}}').otherwise('{"sector": "yml", "policy": {"b": "advisory"}}')
    paths = F.when((n % 3 == 0) & (n % 2 == 0), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2)))
    rows = repos.select(F.lit("repo").alias("scope"), F.col("source").alias("repo"), F.explode(paths).alias("p"), own_yml.alias("y")).select(
        "scope", "repo", F.element_at(F.array(*[F.lit(p) for p in fv.CONFIG_PATHS]), F.col("p") + 1).alias("config_path"),
        F.when(F.col("p") == 0, F.col("y")).otherwise(own_json).alias("body"))
    org = repos.limit(1).select(F.lit("org").alias("scope"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("config_path"),
                                F.lit('{"sector": "finance", "policy": {"a": "blocking", "b": "blocking"}}').alias("body"))
    folder = scratch(spark) + "/config"
    rows.unionByName(org).write.json(folder)
    config = readers.effective_config(readers.read_config(spark, folder))
    return config.select("repo", F.col("config.sector").alias("sector"), F.element_at("config.policy", "b").alias("own_level"), F.element_at("config.policy", "a").alias("org_level"))


@query("P7_data_residency", f"WITH {_CONF} SELECT source AS batch_id FROM c WHERE n % 3 = 1")
def _p7(spark, sf):
    n = F.regexp_replace("source", "src", "").cast("int")
    b = table(spark, sf, "documents").select("source").distinct().select(
        F.col("source").alias("batch_id"), F.when(n % 3 == 1, "eu").when(n % 3 == 2, "us").otherwise("").alias("data_residency"))
    return options.residency_violations(b, "us").select("batch_id")


@query("P9_options", """WITH o AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
 SELECT doc_id, coalesce(CASE doc_id % 3 WHEN 0 THEN true END, quality = 1, doc_id % 2 = 0) AS require_review,
  CASE WHEN doc_id % 4 = 0 THEN 'm' || doc_id WHEN quality IS NOT NULL THEN 'q' || quality ELSE 'global' END AS model,
  CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 WHEN toxic > 0 THEN toxic ELSE 12000 END AS max_chars,
  CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN doc_id % 7 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'safe' END
   WHEN quality = 1 THEN 'full' WHEN quality = 0 THEN 'none' WHEN doc_id % 2 = 0 THEN 'full' WHEN doc_id % 3 = 0 THEN 'safe' ELSE 'none' END AS fix_mode FROM o""")
def _p9(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    none = F.lit(None)
    return d.select(
        "doc_id",
        options.resolve_require_review(F.when(k % 3 == 0, True), F.col("quality") == 1, none.cast("boolean"),
                                       F.when(k % 2 == 0, "TRUE").otherwise("false")).alias("require_review"),
        options.resolve_model(F.when(k % 4 == 0, F.concat(F.lit("  m"), k.cast("string"))).otherwise("  "),
                              F.concat(F.lit("q"), F.col("quality").cast("string")), F.lit("global"), none.cast("string")).alias("model"),
        options.resolve_max_chars((k % 5).cast("int"), F.col("toxic"), none.cast("int"), F.lit("12000")).cast("bigint").alias("max_chars"),
        options.resolve_fix_mode(k % 7 == 0, k % 7 == 1, k % 2 == 0, F.when(F.col("quality") == 1, "full").when(F.col("quality") == 0, "none"),
                                 F.coalesce(k % 3 == 0, F.lit(False))).alias("fix_mode"))


# --- reviewer and fixes ----------------------------------------------------------------------


@query("F17_F28_prompt", f"""SELECT doc_id, {_sql(chr(10).join(review.PROMPT_HEAD))} || {NL} || 'Repo: ' || source || {NL} || 'File: ' || source || '/' || doc_id || '.txt' || {NL} || 'Language: text'
  || CASE WHEN doc_id % 2 = 0 THEN {NL} || 'PR: ' || doc_id ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN {NL} || 'Commit: abc' ELSE '' END || {NL} || 'Copilot suspected: ' || CASE WHEN doc_id % 5 = 0 THEN 'True' ELSE 'False' END
  || CASE WHEN length(text) > 1000 THEN {NL} || 'Note: File content truncated for analysis.' ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN {NL} || {NL} || 'Diff:' || {NL} || '+x' || {NL} || {NL} || 'Full file content (for context):' || {NL} ELSE {NL} || {NL} || 'File content:' || {NL} END
  || substr(text, 1, 1000) AS prompt FROM documents""")
def _f17(spark, sf):
    k = F.col("file_ord")
    return docs(spark, sf).select(k.alias("doc_id"), review.prompt(
        F.col("code"), F.col("path"), text.guess_language(F.col("path")), F.when(k % 4 == 0, "+x").otherwise(""), F.col("batch_id"),
        F.when(k % 2 == 0, k.cast("int")), F.when(k % 3 == 0, "abc"), k % 5 == 0, F.lit(1000)).alias("prompt"))


def _answers(spark, sf):
    """Answers of a reviewer: fenced lists, wrapped lists, talk around a list, broken ones."""
    k = F.col("doc_id")
    item = F.format_string('{"type": "t%s", "severity": " Blocking ", "category": "SECURITY", "message": "m", "line": %s, "references": ["r"]}', k, k)
    rest = F.lit('"loose text", {"severity": "odd", "references": 5}')
    listed = F.concat(F.lit("["), item, F.lit(", "), rest, F.lit("]"))
    answer = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
        .when(k % 5 == 1, F.concat(F.lit('{"findings": '), listed, F.lit("}")))
        .when(k % 5 == 2, F.concat(F.lit("Here you are: "), listed, F.lit(" done")))
        .when(k % 5 == 3, F.lit("[]")).otherwise("no json here"))
    return table(spark, sf, "documents").select(
        F.col("source").alias("batch_id"), k.alias("file_ord"), F.concat("source", F.lit("/"), k.cast("string")).alias("path"),
        answer.alias("answer"), F.lit(None).cast("string").alias("error"))


@query("F12_F15_F16_review_answers", """SELECT doc_id AS file_ord, 't' || doc_id AS type, 'security' AS category, 'blocking' AS severity, 'm' AS message, CAST(doc_id AS INTEGER) AS line, 1 AS n_refs FROM documents WHERE doc_id % 5 < 3
 UNION ALL SELECT doc_id, 'ai_review', 'maintainability', 'advisory', 'AI review finding.', NULL, 0 FROM documents WHERE doc_id % 5 < 3
 UNION ALL SELECT doc_id, 'ai_review_error', 'reliability', 'warning', 'AI review failed.', NULL, 0 FROM documents WHERE doc_id % 5 = 4""")
def _f15(spark, sf):
    found = review.answers_to_findings(_answers(spark, sf))
    return found.select("file_ord", "type", "category", "severity", "message", "line", F.size("references").alias("n_refs"))


@query("X4_reviewer", f"WITH {CORPUS} SELECT path, CASE WHEN contains(code, 'eval(') THEN 'ai_review_error' ELSE 'seen' END AS type, CASE WHEN contains(code, 'eval(') THEN 'refused' ELSE '' END AS explanation FROM files")
def _x4(spark, sf):
    def reviewer(prompt: str) -> str:
        if "eval(" in prompt:
            raise RuntimeError("refused")
        return '[{"type": "seen"}]'

    return review.review(corpus(spark, sf), reviewer, max_chars=10_000_000).select("path", "type", "explanation")


@query("F25_strip_fence", r"SELECT doc_id, regexp_replace(text || chr(10), '^[ \t\n\x0B\f\r]+', '') AS text FROM documents")
def _f25(spark, sf):
    d = table(spark, sf, "documents")
    fenced = F.concat(F.lit("```python\n"), "text", F.lit("\n```\n"))
    return d.select("doc_id", text.strip_fence(fenced).alias("text"))


@query("D30_missing_key", """SELECT doc_id AS file_ord, f AS family, 'ai_review_missing_key' AS type, 'blocking' AS severity
 FROM documents CROSS JOIN (VALUES ('ai'), ('issues')) AS v(f) WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0""")
def _d30(spark, sf):
    k = F.col("file_ord")
    files = docs(spark, sf).withColumn("require_ai_review", F.when(k % 3 == 0, False)).withColumn("has_key", k % 2 == 1)
    return review.missing_key(files).select("file_ord", "family", "type", "severity")


@query("S8_F13_F14_L8_static_findings", """SELECT event_id AS file_ord, 'static_analysis' AS type,
  CASE WHEN event_type = 'view' THEN 'rule-' || event_id ELSE event_type END AS message, CASE event_type WHEN 'error' THEN 'blocking' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'warning' ELSE 'advisory' END AS severity,
  CAST(event_id % 100 AS INTEGER) AS line, CASE WHEN event_id % 2 = 0 THEN 'CWE-1' END AS cwe, CASE WHEN event_id % 3 = 0 THEN 'A01' END AS owasp, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n_refs FROM events""")
def _s8(spark, sf):
    k, kind = F.col("event_id"), F.col("event_type")
    level = F.when(kind == "error", "Error").when(kind == "click", " MEDIUM").when(kind == "view", "").otherwise("info")
    meta = F.concat(
        F.lit('{"owasp": '), F.when(k % 3 == 0, '["A01", "A02"]').otherwise("[]"),
        F.when(k % 2 == 0, ', "cwe": ["CWE-1", "CWE-2"], "references": ["a", "b"]').otherwise(', "cwe": []'), F.lit("}"))
    body = F.concat(
        F.lit('{"results": [{"check_id": "rule-'), k.cast("string"), F.lit('", "start": {"line": '), (k % 100).cast("string"), F.lit('}, "extra": {"message": "'),
        F.when(kind == "view", "").otherwise(kind), F.lit('", "severity": "'), level, F.lit('", "metadata": '), meta, F.lit("}}]}"))
    rows = table(spark, sf, "events").select(F.lit("b").alias("batch_id"), k.alias("file_ord"), F.lit("p").alias("path"), body.alias("json"))
    return review.static_findings(rows).select("file_ord", "type", "message", "severity", "line", "cwe", "owasp", F.size("references").alias("n_refs"))


_LOGGED = "replace(code, 'print(', 'logger.info(')"
_SETUP = f"'import logging' || {NL} || {NL} || 'logger = logging.getLogger(__name__)' || {NL}"


@query("F24_safe_fix", f"""WITH {CORPUS} SELECT path, contains(code, 'print(') AND ext = '.py' AS changed,
  CASE WHEN contains(code, 'print(') AND ext = '.py' THEN {_SETUP} || {_LOGGED} ELSE code END AS code FROM files""")
def _f24(spark, sf):
    return fixes.safe_fix(corpus(spark, sf)).select("path", (F.size("changes") > 0).alias("changed"), "code")


_HEAD = '#!/usr/bin/python\n# coding: utf-8\n\n"""Text\n\nmore"""\n'


@query("X2_header_placement", f"""WITH {CORPUS}, head AS (SELECT '{_HEAD}' AS h) SELECT path, h || {_SETUP} || {_LOGGED} AS code, h || code AS original
 FROM files, head WHERE ext = '.py' AND contains(code, 'print(')""")
def _x2(spark, sf):
    headed = corpus(spark, sf).withColumn("code", F.concat(F.lit(_HEAD), "code"))
    return fixes.safe_fix(headed).where(F.size("changes") > 0).select("path", "code", "original")


@query("K5_backups", f"WITH {CORPUS} SELECT path, code FROM files WHERE ext = '.py' AND contains(code, 'print(')")
def _k5(spark, sf):
    folder = scratch(spark) + "/backup"
    writers.write_backups(fixes.safe_fix(corpus(spark, sf)), folder)
    return spark.read.parquet(folder).select("path", "code")


@query("F26_client_key", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id WHEN event_id % 3 = 1 THEN 'h' || user_id ELSE 'unknown' END AS client FROM events""")
def _f26(spark, sf):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    forwarded = F.when(k % 3 == 0, F.concat(F.lit(" u"), u, F.lit(" , 10.0.0.1"))).otherwise("")
    host = F.when(k % 3 == 1, F.concat(F.lit("h"), u))
    return table(spark, sf, "events").select("event_id", text.client_key(forwarded, host).alias("client"))


@query("F10_iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS stamp FROM events")
def _f10(spark, sf):
    return table(spark, sf, "events").select("event_id", au.iso_utc(F.col("ts")).alias("stamp"))


_TREE = f"WITH {CORPUS} SELECT path, length(code) AS size FROM files WHERE ext <> '.sql' AND batch_id <> 'src3'"


@query("S1_read_tree", _TREE)
def _s1(spark, sf):
    """Texts written one file per row below a folder, and read back as a tree."""
    return _read_tree(spark, sf, "walk")


@query("S1_tree_source", _TREE)
def _s1_source(spark, sf):
    """The same through the data source, whose partitions are planned from the listing."""
    return _read_tree(spark, sf, "source")


def _read_tree(spark, sf, listing):
    root = scratch(spark) + "/tree"
    rows = corpus(spark, sf).select("batch_id", "file_ord", F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("ext"), "code")
    folder = F.when(F.col("batch_id") == "src3", F.concat("batch_id", F.lit("/node_modules"))).otherwise(F.col("batch_id"))
    _write_tree(rows.select(F.concat_ws("/", folder, F.concat(F.col("file_ord").cast("string"), "ext")).alias("path"), "code"), root)
    return readers.read_tree(spark, root, listing=listing).select("path", F.length("code").cast("bigint").alias("size"))


def _write_tree(files, root: str) -> None:
    """One file per row, written by the tasks (a fixture for reading trees)."""

    def save(rows):
        from codesieve.sources import tree

        system, start = tree._open(root)
        for r in rows:
            system.create_dir(f"{start}/{r.path}".rpartition("/")[0], recursive=True)
            with system.open_output_stream(f"{start}/{r.path}") as out:
                out.write(r.code.encode())

    files.foreachPartition(save)


@query("S6_license_files", """SELECT source || '/' || ['LICENSE', 'COPYING.txt', 'NOTICE', 'license', 'LICENSE.rst'][doc_id % 5 + 1] AS path, doc_id AS file_ord FROM documents
 WHERE doc_id % 5 < 3 AND text <> '' AND length(text) <= 3000""")
def _s6(spark, sf):
    from codesieve.operators.licenses import license_files

    names = F.array(*[F.lit(x) for x in ["LICENSE", "COPYING.txt", "NOTICE", "license", "LICENSE.rst"]])
    files = docs(spark, sf).withColumn("path", F.concat("batch_id", F.lit("/"), F.element_at(names, (F.col("file_ord") % 5 + 1).cast("int"))))
    return license_files(files, 3000).select("path", "file_ord")
