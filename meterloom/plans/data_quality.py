"""Queries p2 to p5: regular grids, hot keys, rows that fail to parse, implausible readings; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.operators import badrows, gridfill, hotkeys, spikes
from meterloom.sources.tables import table

HOT_SHARE = 0.03


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return gridfill.regular_grid(gridfill.gauge_readings(table(spark, d, "binary_out_prefix"), table(spark, d, "binary_sink")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("gap").select("key", "slot")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    def of(src: str, key: str) -> DataFrame:
        return hotkeys.heavy_hitters(table(spark, d, src), key, HOT_SHARE).select(F.lit(src).alias("src"), "hot_key")

    return of("ascii_parser", "name").unionByName(of("binary_sink", "key"))


def p3_key_results(spark: SparkSession, d: str) -> DataFrame:
    """Per name and key: rows, different values (hosts), first and last arrival."""

    def of(src: str, key: str, what: str, at: str) -> DataFrame:
        rows = table(spark, d, src).select(F.col(key).alias("key"), F.col(what).alias("what"), F.col(at).alias("at"))
        add = F.sum
        out = hotkeys.split_aggregate(
            rows,
            "key",
            {"n": F.count(F.lit(1)), "n_different": F.count_distinct("what"), "first_at": F.min("at"), "last_at": F.max("at")},
            {"n": add, "n_different": add, "first_at": F.min, "last_at": F.max},
            salt_on=["what"],
        )
        return out.select(F.lit(src).alias("src"), "*")

    return of("ascii_parser", "name", "value", "ts").unionByName(of("binary_sink", "key", "sink_host", "recv_at"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Every message and line, typed or with its reason: one pass for what is loaded and what is rejected."""
    a = badrows.parse_messages(table(spark, d, "ascii_parser")).select(F.lit("ascii_parser").alias("src"), "*")
    b = badrows.parse_spool(table(spark, d, "ascii_raw")).select(F.lit("ascii_raw").alias("src"), "*")
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("reason is not null").select("src", "row_id")


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every rejected row with the reason."""
    return _judged(spark, d).where("reason is not null").select("src", "row_id", "reason")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid samples, typed."""
    return badrows.valid_rows(_judged(spark, d))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    readings = gridfill.gauge_readings(table(spark, d, "binary_out_prefix"), table(spark, d, "binary_sink"))
    return spikes.flag_records(readings, table(spark, d, "gauge_kinds"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).select("rec_id")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every implausible record with the reason."""
    return _flags(spark, d)


def p5_limits_and_frozen(spark: SparkSession, d: str) -> DataFrame:
    """The implausible records whose reason SQL can tell: values that cannot occur, and frozen stretches."""
    return _flags(spark, d).where("reason <> 'spike'")


QUERIES = {
    "p2_found": p2_found,
    "p2_grid": p2_grid,
    "p3_found": p3_found,
    "p3_key_results": p3_key_results,
    "p4_found": p4_found,
    "p4_reasons": p4_reasons,
    "p4_loaded": p4_loaded,
    "p5_found": p5_found,
    "p5_reasons": p5_reasons,
    "p5_limits_and_frozen": p5_limits_and_frozen,
}

_READINGS = """
readings AS (
  SELECT s.key, p.rec_id, p.timestamp AS ts, p.val, CAST(floor(p.timestamp / 60.0) AS BIGINT) AS slot_no
  FROM binary_out_prefix p JOIN binary_sink s USING (rec_id)
  WHERE p.type = 5 AND p.timestamp IS NOT NULL AND p.val IS NOT NULL AND NOT isnan(p.val) AND s.key IS NOT NULL
),
slots AS (SELECT key, slot_no, arg_max(val, CAST(ts AS HUGEINT) * 10000000000 + rec_id) AS val, count(*) AS n FROM readings GROUP BY ALL),
nexts AS (SELECT *, lead(slot_no) OVER (PARTITION BY key ORDER BY slot_no) AS next_no FROM slots),
gaps AS (SELECT key, unnest(generate_series(slot_no + 1, next_no - 1)) AS slot_no, val FROM nexts WHERE next_no > slot_no + 1)
"""

_NUMBER = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"


def _fails(name: str, value: str, kind: str, rate: str) -> str:
    num = f"regexp_full_match({{}}, '{_NUMBER}')"
    finite = "abs(coalesce(TRY_CAST({0} AS DOUBLE), 'inf'::DOUBLE)) < 'inf'::DOUBLE"
    return f"""NOT coalesce(
      {name} IS NOT NULL AND trim({name}, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND strpos({name}, ':') = 0
      AND {kind} IN ('kv', 'g', 'c', 'ms', 'h', 's')
      AND CASE WHEN {kind} = 's' THEN {value} <> '' AND strpos({value}, '|') = 0
               ELSE {num.format(value)} AND {finite.format(value)} END
      AND CASE WHEN {rate} IS NULL THEN true WHEN {kind} NOT IN ('c', 'ms', 'h') THEN false
               ELSE {num.format(rate)} AND TRY_CAST({rate} AS DOUBLE) > 0 AND TRY_CAST({rate} AS DOUBLE) <= 1 END, false)"""


def _reason(name: str, value: str, kind: str, rate: str) -> str:
    num = f"regexp_full_match({{}}, '{_NUMBER}')"
    return f"""CASE WHEN {name} IS NULL THEN 'name missing' WHEN trim({name}, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'name blank'
      WHEN strpos({name}, ':') > 0 THEN 'name has a colon' WHEN {kind} IS NULL OR {kind} NOT IN ('kv', 'g', 'c', 'ms', 'h', 's') THEN 'type unknown'
      WHEN {value} IS NULL THEN 'value missing' WHEN {value} = '' THEN 'value empty'
      WHEN {kind} = 's' AND strpos({value}, '|') > 0 THEN 'set member has a bar'
      WHEN {kind} <> 's' AND NOT {num.format(value)} THEN 'value is no number'
      WHEN {kind} <> 's' AND NOT coalesce(abs(TRY_CAST({value} AS DOUBLE)) < 'inf'::DOUBLE, false) THEN 'value not finite'
      WHEN {rate} IS NULL THEN NULL WHEN {kind} NOT IN ('c', 'ms', 'h') THEN 'rate not allowed for type'
      WHEN NOT {num.format(rate)} THEN 'rate is no number'
      WHEN NOT coalesce(TRY_CAST({rate} AS DOUBLE) > 0 AND TRY_CAST({rate} AS DOUBLE) <= 1, false) THEN 'rate out of range' END"""


_SPLIT = r'(?s)^("[0-9]+"|[0-9]+),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)$'
_UNQUOTE = "CASE WHEN {0} LIKE '\"%' THEN replace({0}[2:-2], '\"\"', '\"') ELSE {0} END"

_LINES = f"""
split AS (
  SELECT line_id, coalesce(regexp_full_match(line, '{_SPLIT}'), false) AS ok,
         regexp_extract(line, '{_SPLIT}', ['a', 'b', 'c', 'd', 'e']) AS f
  FROM ascii_raw
),
fields AS (
  SELECT line_id, ok, {_UNQUOTE.format("f.b")} AS name, {_UNQUOTE.format("f.c")} AS value, {_UNQUOTE.format("f.d")} AS kind,
         nullif({_UNQUOTE.format("f.e")}, '') AS rate
  FROM split
)
"""

#: Fields that end with a comma, as many as can be told apart from the left, and what is then left of the line.
_WHOLE = r'(?:"(?:[^"]|"")*"|[^",]*),'

_REASONS = f"""
cut AS (SELECT line_id, regexp_replace(line, '(?s)^(?:{_WHOLE})*', '') AS rest FROM ascii_raw WHERE line IS NOT NULL),
counted AS (SELECT c.line_id, rest, len(regexp_extract_all(left(r.line, length(r.line) - length(rest)), '(?s){_WHOLE}')) + 1 AS n FROM cut c JOIN ascii_raw r USING (line_id)),
line_reasons AS (
  SELECT line_id, CASE
    WHEN regexp_full_match(rest, '(?s)"(?:[^"]|"")*"|[^",]*') THEN CASE WHEN n < 5 THEN 'too few fields' WHEN n > 5 THEN 'too many fields' ELSE 'time is not digits' END
    WHEN NOT starts_with(rest, '"') THEN 'quote inside unquoted field'
    WHEN regexp_matches(rest, '(?s)^"(?:[^"]|"")*"[^",]') THEN 'text after closing quote' ELSE 'quote not closed' END AS reason
  FROM counted)
"""

ORACLE_SQL = {
    "p2_found": f"WITH {_READINGS} SELECT key, slot_no * 60 AS slot FROM gaps",
    "p2_grid": f"""WITH {_READINGS}
      SELECT key, slot_no * 60 AS slot, val, n, false AS gap FROM slots
      UNION ALL SELECT key, slot_no * 60 AS slot, val, CAST(0 AS BIGINT) AS n, true AS gap FROM gaps""",
    "p5_limits_and_frozen": f"""WITH {_READINGS},
      once AS (SELECT DISTINCT key, ts, val FROM readings),
      marked AS (SELECT *, CASE WHEN val = lag(val) OVER (PARTITION BY key ORDER BY ts, val) THEN 0 ELSE 1 END AS new FROM once),
      numbered AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, val) AS run FROM marked),
      sized AS (SELECT *, count(*) OVER (PARTITION BY key, run) AS n FROM numbered),
      sources AS (SELECT key, count(*) FILTER (n < 12) AS rest, count(DISTINCT run) FILTER (n < 12) AS changes FROM sized GROUP BY key),
      judged AS (
        SELECT s.key, s.ts, s.val, CASE WHEN s.val < k.low OR s.val > k.high THEN 'limit' WHEN n >= 12 AND rest >= 12 AND rest - changes <= 0.2 * rest THEN 'frozen' END AS reason
        FROM sized s JOIN sources USING (key) LEFT JOIN gauge_kinds k ON k.kind = split_part(s.key, '.', -1))
      SELECT r.rec_id, j.reason FROM readings r JOIN judged j ON r.key = j.key AND r.ts = j.ts AND r.val = j.val WHERE j.reason IS NOT NULL""",
    "p3_found": " UNION ALL ".join(
        f"""SELECT '{t}' AS src, {k} AS hot_key FROM {t} WHERE {k} IS NOT NULL GROUP BY {k}
            HAVING count(*) >= 0.03 * (SELECT count(*) FROM {t})"""
        for t, k in (("ascii_parser", "name"), ("binary_sink", "key"))
    ),
    "p3_key_results": " UNION ALL ".join(
        f"""SELECT '{t}' AS src, {k} AS key, count(*) AS n, count(DISTINCT {w}) AS n_different, min({a}) AS first_at, max({a}) AS last_at
            FROM {t} GROUP BY {k}"""
        for t, k, w, a in (("ascii_parser", "name", "value", "ts"), ("binary_sink", "key", "sink_host", "recv_at"))
    ),
    "p4_found": f"""WITH {_LINES}
      SELECT 'ascii_parser' AS src, seq AS row_id FROM ascii_parser WHERE {_fails("name", "value", "type", "samplerate")}
      UNION ALL SELECT 'ascii_raw' AS src, line_id AS row_id FROM fields WHERE NOT ok OR {_fails("name", "value", "kind", "rate")}""",
    "p4_reasons": f"""WITH {_LINES}, {_REASONS}, every AS (
      SELECT 'ascii_parser' AS src, seq AS row_id, {_reason("name", "value", "type", "samplerate")} AS reason FROM ascii_parser
      UNION ALL SELECT 'ascii_raw', line_id, {_reason("name", "value", "kind", "rate")} FROM fields WHERE ok
      UNION ALL SELECT 'ascii_raw', line_id, coalesce(reason, 'line missing') FROM fields LEFT JOIN line_reasons USING (line_id) WHERE NOT ok)
      SELECT * FROM every WHERE reason IS NOT NULL""",
    "p4_loaded": f"""WITH {_LINES},
      good AS (
        SELECT 'ascii_parser' AS src, seq AS row_id, name, type AS kind, value, samplerate AS rate
        FROM ascii_parser WHERE NOT ({_fails("name", "value", "type", "samplerate")})
        UNION ALL SELECT 'ascii_raw', line_id, name, kind, value, rate FROM fields
        WHERE ok AND NOT ({_fails("name", "value", "kind", "rate")}))
      SELECT src, row_id, name, kind AS type, CASE WHEN kind <> 's' THEN CAST(value AS DOUBLE) END AS number,
             CASE WHEN kind = 's' THEN value END AS member, CAST(coalesce(rate, '1') AS DOUBLE) AS rate FROM good""",
}
