"""Queries of the quote operators over whole tables, each with the same rules in SQL of another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill import patterns as P
from quotemill.operators import adjustments, classify, currency, descriptions, grouping, lines, numbers, parsing, scoring, units
from quotemill.plans import money_sql
from quotemill.runtime import own_path, spread
from quotemill.streaming import ingest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_of(docs(spark, sf_dir))


def read_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "quote_items").select("item_id", "doc_id", "line_no", "description", "quantity", "unit_price", "cost")
    return units.read_items(items, *(table(spark, sf_dir, n) for n in ("quote_summary", "feeds", "money_units")))


def typed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quote_items with whole quantities, and prices a piece and costs in US dollars."""
    return read_items(spark, sf_dir).drop("unread")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


LINES = r"""l AS (SELECT doc_id, unnest(range(len(x)))::INTEGER AS line_no, unnest(x) AS line FROM
 (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM documents WHERE text IS NOT NULL))"""
TRIMMED = LINES + ", t AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM l)"
ITEMS = money_sql.TYPED


@query("doc_lines", f"WITH {LINES} SELECT * FROM l")
def _(s, d):
    return doc_lines(s, d)


@query(
    "number_tokens",
    f"""WITH {LINES}, m AS (SELECT doc_id, line_no, line, regexp_extract_all(line, {literal(P.NUMBER)}) AS n FROM l)
 SELECT doc_id, line_no, unnest(range(len(n)))::INTEGER AS place, replace(unnest(n), ',', '')::DECIMAL(38,2)::DOUBLE AS value FROM m""",
)
def _(s, d):
    return numbers.number_tokens(doc_lines(s, d)).select("doc_id", "line_no", "place", "value")


@query("number_places")
def _(s, d):
    return numbers.number_tokens(doc_lines(s, d)).select("doc_id", "line_no", "place", "start", "raw", "is_money", "is_quantity")


FIGURE = r"regexp_replace(unit_price, '[^0-9.,\-]', '', 'g')"


@query(
    "price_normalize",
    f"""WITH f AS (SELECT item_id, {FIGURE} AS x FROM quote_items) SELECT item_id,
 CASE WHEN x IS NULL THEN 0 ELSE coalesce(try_cast(CASE WHEN regexp_full_match(x, '-?\\d{{1,3}}(\\.\\d{{3}})+,\\d{{2}}') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '') END AS DECIMAL(18,2)), 0)::DOUBLE END AS price FROM f""",
)
def _(s, d):
    t = table(s, d, "quote_items")
    return t.select("item_id", numbers.us_number(numbers.plain_figure(F.col("unit_price"))).cast("double").alias("price"))


@query(
    "european_numbers",
    f"""WITH f AS (SELECT item_id, {FIGURE} AS x FROM quote_items) SELECT item_id, try_cast(CASE
 WHEN regexp_full_match(x, '-?\\d{{1,3}}(\\.\\d{{3}})*,\\d{{1,2}}') THEN replace(replace(x, '.', ''), ',', '.')
 WHEN regexp_full_match(x, '-?\\d+,\\d{{1,2}}') THEN replace(x, ',', '.')
 WHEN regexp_full_match(x, '-?\\d{{1,3}}(,\\d{{3}})*(\\.\\d+)?') OR regexp_full_match(x, '-?\\d+(\\.\\d+)?') THEN replace(x, ',', '') END AS DECIMAL(18,2))::DOUBLE AS price FROM f""",
)
def _(s, d):
    return table(s, d, "quote_items").select("item_id", numbers.european_number(numbers.plain_figure(F.col("unit_price"))).cast("double").alias("price"))


@query(
    "last_separator_numbers",
    f"""WITH f AS (SELECT item_id, {FIGURE} AS x FROM quote_items) SELECT item_id, round_even(try_cast(CASE
 WHEN contains(x, ',') AND contains(x, '.') AND instr(reverse(x), ',') < instr(reverse(x), '.') THEN replace(replace(x, '.', ''), ',', '.')
 WHEN contains(x, ',') AND NOT contains(x, '.') AND regexp_matches(x, ',\\d{{0,2}}$') THEN replace(x, ',', '.')
 ELSE replace(x, ',', '') END AS DECIMAL(18,4)), 2)::DOUBLE AS price FROM f""",
)
def _(s, d):
    return table(s, d, "quote_items").select("item_id", numbers.last_separator_number(numbers.plain_figure(F.col("unit_price"))).cast("double").alias("price"))


@query(
    "infer_quantity",
    f"""WITH {ITEMS} SELECT item_id, CASE WHEN unit_price > 0 AND round_even(cost / unit_price, 0) BETWEEN 1 AND 100000 AND abs(round_even(cost / unit_price, 0) * unit_price - cost) <= 0.05 * abs(cost)
 THEN round_even(cost / unit_price, 0)::INTEGER ELSE 1 END AS inferred FROM i""",
)
def _(s, d):
    return typed_items(s, d).select("item_id", numbers.infer_quantity(F.col("unit_price"), F.col("cost")).alias("inferred"))


@query("flexible_quantity")
def _(s, d):
    return doc_lines(s, d).select("doc_id", "line_no", numbers.flexible_quantity(F.col("line")).alias("quantity"))


@query(
    "cid_cleanup",
    f"""WITH {TRIMMED}, c AS (SELECT *, trim(regexp_replace(regexp_replace(line, '\\bcid:\\d+\\s*', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS b FROM t)
 SELECT doc_id, line_no, CASE WHEN regexp_full_match(b, '[:\\s.,\\-]+') THEN '' ELSE b END AS line FROM c WHERE contains(line, 'cid:')""",
)
def _(s, d):
    t = doc_lines(s, d).withColumn("line", F.trim("line")).where(F.contains("line", F.lit("cid:")))
    return t.select("doc_id", "line_no", lines.strip_cid(F.col("line")).alias("line"))


WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


@query(
    "cid_garbage",
    f"WITH {TRIMMED}, w AS (SELECT doc_id, line_no, {WORDS.format('line')} AS w FROM t) SELECT doc_id, line_no FROM w WHERE len(w) > 0 AND 2 * len(list_filter(w, lambda x: contains(x, 'cid:'))) > len(w)",
)
def _(s, d):
    return doc_lines(s, d).where(lines.mostly_cid(F.trim("line"))).select("doc_id", "line_no")


@query(
    "ocr_digit_repair",
    f"""WITH {LINES} SELECT doc_id, line_no, array_to_string(list_transform({WORDS.format('line')},
 lambda w: CASE WHEN regexp_full_match(w, '[$0-9.,\\-OlI§S]+') THEN translate(w, 'OlIS§', '01155') ELSE w END), ' ') AS line FROM l""",
)
def _(s, d):
    return doc_lines(s, d).select("doc_id", "line_no", lines.repair_digits(F.col("line")).alias("line"))


@query("preprocessed_lines")
def _(s, d):
    return lines.preprocess(doc_lines(s, d))


@query(
    "clean_description",
    "SELECT item_id, trim(regexp_replace(regexp_replace(description, '[^\\pL\\pM\\pN\\s_:\\-]', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS description FROM quote_items",
)
def _(s, d):
    return table(s, d, "quote_items").select("item_id", lines.clean_description(F.col("description")).alias("description"))


def _expand_oracle() -> str:
    # one CTE a word, for nested expressions would double with each
    names, ctes = list(P.ABBREVIATIONS.items()), ["e0 AS MATERIALIZED (SELECT item_id, description, description AS x FROM quote_items)"]
    for k, (short, full) in enumerate(names, 1):
        ctes.append(f"e{k} AS MATERIALIZED (SELECT item_id, description, CASE WHEN contains(lower(description), '{short}') THEN regexp_replace(x, '(^|[^\\pL\\pN_]){short}($|[^\\pL\\pN_])', '\\1{full}\\2', 'gi') ELSE x END AS x FROM e{k - 1})")
    return f"WITH {', '.join(ctes)} SELECT item_id, x AS description FROM e{len(names)}"


@query("expand_abbreviations", _expand_oracle())
def _(s, d):
    return table(s, d, "quote_items").select("item_id", descriptions.expand(F.col("description")).alias("description"))


@query(
    "normalize_header",
    "SELECT DISTINCT method AS header, CASE method WHEN 'total' THEN 'total_cost' ELSE method END AS field FROM method_results",
)
def _(s, d):
    return table(s, d, "method_results").select("method").distinct().select(F.col("method").alias("header"), descriptions.header(F.col("method")).alias("field"))


@query("line_skip_filter", f"WITH {TRIMMED} SELECT doc_id, line_no FROM t WHERE regexp_matches(lower(line), {literal(P.SKIP_PATTERN)})")
def _(s, d):
    return doc_lines(s, d).where(F.lower(F.trim("line")).rlike(P.SKIP_PATTERN)).select("doc_id", "line_no")


@query(
    "candidate_lines",
    f"""WITH {TRIMMED}, c AS (SELECT *, len(regexp_extract_all(line, {literal(P.NUMBER)}))::INTEGER AS figures FROM t WHERE NOT regexp_matches(lower(line), {literal(P.SKIP_PATTERN)}))
 SELECT doc_id, line_no, figures FROM c WHERE figures >= 2 OR (figures = 1 AND (regexp_matches(upper(line), '[A-Z]+-\\d+') OR (contains(line, '$') AND regexp_matches(lower(line), '{"|".join(P.INCOMPLETE_WORDS)}'))))""",
)
def _(s, d):
    return lines.candidates(doc_lines(s, d)).select("doc_id", "line_no", "figures")


MARKS = r"(length({0}) - length(regexp_replace({0}, '[^A-Za-z0-9_\s]', '', 'g')))"


@query(
    "garbled_lines",
    f"""WITH {LINES} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '<0a>|<[0-9a-f]{{2}}>|Internal Error:|Cannot handle URI|[A-Za-z]{{20,}}|[^\\x00-\\x7F\\pL]{{10,}}|[^\\pL\\pM\\pN_\\s]{{5,}}')
 OR (length(line) > 0 AND 10 * {MARKS.format('line')} > 3 * length(line))""",
)
def _(s, d):
    return doc_lines(s, d).where(classify.is_garbled(F.col("line"))).select("doc_id", "line_no")


def _noise_oracle() -> str:
    parts = [f"CASE WHEN len(w) < 2 THEN 3 ELSE 0 END + CASE WHEN 2 * len(list_filter(w, lambda x: length(x) = 1)) > len(w) THEN 8 ELSE 0 END + CASE WHEN regexp_matches(line, '\\pL\\s+\\d\\s+\\pL\\s+\\d') THEN 6 ELSE 0 END"]
    parts += [f"CASE WHEN regexp_matches(line, {literal(p)}) THEN 7 ELSE 0 END" for p in classify.TECHNICAL_NOISE]
    parts += [f"CASE WHEN regexp_matches(lower(line), {literal(p)}) THEN 9 ELSE 0 END" for p in classify.METADATA_NOISE]
    parts += [f"CASE WHEN 10 * {MARKS.format('line')} > 3 * length(line) THEN 6 ELSE 0 END", "CASE WHEN 2 * (length(line) - length(regexp_replace(line, '[0-9]', '', 'g'))) > length(line) THEN 4 ELSE 0 END"]
    parts += ["CASE WHEN length(trim(line, ' ')) < 10 THEN 2 WHEN length(trim(line, ' ')) > 200 THEN 3 ELSE 0 END"]
    return f"(CASE WHEN length(line) = 0 THEN 10 ELSE {' + '.join(parts)} END)::INTEGER"


NOISE = _noise_oracle()


@query("line_noise_score", f"WITH {LINES}, w AS (SELECT *, {WORDS.format('line')} AS w FROM l) SELECT doc_id, line_no, {NOISE} AS noise FROM w")
def _(s, d):
    return doc_lines(s, d).select("doc_id", "line_no", classify.noise_score(F.col("line")).alias("noise"))


def _feature_sql() -> str:
    flags = {
        "has_numbers": "regexp_matches(line, '\\d')",
        "has_currency": "regexp_matches(line, '[$€£¥₹]')",
        "has_quantities": "regexp_matches(low, '\\b\\d+\\s*(?:pcs?|units?|items?|pieces?|boxes?|sets?|kits?|lots?)\\b')",
        "has_part_numbers": "regexp_matches(line, '\\b[A-Z]{2,}\\d+[A-Z0-9\\-]*\\b')",
        "has_urls": "regexp_matches(line, 'https?://|www\\.')",
        "has_code": "regexp_matches(line, '[<>/\\\\|&{}\\[\\]]{2,}|def\\s+|class\\s+|import\\s+')",
        "has_technical": f"regexp_matches(low, '{'|'.join(P.TECHNICAL)}')",
        "has_business": f"regexp_matches(low, '{'|'.join(P.BUSINESS)}')",
        "has_contact": f"regexp_matches(low, '{'|'.join(P.CONTACT)}')",
        "has_metadata": f"regexp_matches(low, '{'|'.join(P.METADATA)}')",
        "is_discount": f"(regexp_matches(low, '{'|'.join(P.DISCOUNT)}') OR (regexp_matches(line, '-\\$?\\d+') AND length(trim(line, ' ')) <= 20))",
    }
    return f"WITH {LINES}, f0 AS (SELECT *, lower(line) AS low FROM l), f AS (SELECT doc_id, line_no, line, length(line)::INTEGER AS length, len({WORDS.format('line')})::INTEGER AS word_count, " + ", ".join(f"{v} AS {k}" for k, v in flags.items()) + " FROM f0)"


@query("classify_features", _feature_sql() + " SELECT * EXCLUDE (line) FROM f")
def _(s, d):
    return classify.features(doc_lines(s, d)).drop("line")


@query(
    "classify_score",
    _feature_sql()
    + ", s AS (SELECT *, "
    + " + ".join(f"(CASE WHEN {k} THEN {v} ELSE 0 END)" for k, v in classify.WEIGHTS.items())
    + " + CASE WHEN word_count BETWEEN 3 AND 25 THEN 15 ELSE 0 END + CASE WHEN has_technical AND NOT has_numbers AND word_count >= 2 THEN 30 ELSE 0 END - CASE WHEN word_count < 2 THEN 20 ELSE 0 END - CASE WHEN word_count > 50 THEN 10 ELSE 0 END AS raw FROM f)"
    + " SELECT doc_id, line_no, (CASE WHEN length(trim(line, ' ')) < 2 THEN 0 ELSE least(greatest(raw, 0), 100) END)::INTEGER AS score, (CASE WHEN length(trim(line, ' ')) < 2 THEN 0 ELSE least(greatest(raw, 0), 100) END) >= 35 AS is_item FROM s",
)
def _(s, d):
    return classify.item_score(classify.features(doc_lines(s, d))).select("doc_id", "line_no", "score", "is_item")


@query(
    "multiline_merge",
    f"""WITH {TRIMMED}, a AS (SELECT *, len(regexp_extract_all(line, {literal(P.ROW_NUMBER)})) AS n FROM t),
 b AS (SELECT *, n >= 3 AND line <> '' AS is_row, line <> '' AND n <= 2 AND regexp_matches(lower(line), {literal(P.CONTINUATION)}) AS goes_on FROM a),
 c AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM b),
 d AS (SELECT *, first(is_row) OVER (PARTITION BY doc_id, island ORDER BY line_no) AS headed, min(line_no) OVER (PARTITION BY doc_id, island) AS m FROM c),
 g AS (SELECT doc_id, CASE WHEN headed THEN m ELSE line_no END AS line_no, bool_or(headed) AS headed, string_agg(line, ' ' ORDER BY d.line_no) AS line, count(*)::INTEGER AS n_lines FROM d WHERE line <> '' GROUP BY 1, 2)
 SELECT doc_id, line_no, n_lines, CASE WHEN headed THEN regexp_replace(regexp_replace(line, '(\\d+)_\\s+(\\d+-)', '\\1_\\2', 'g'), '(\\d+)\\s+_(\\d+-)', '\\1_\\2', 'g') ELSE line END AS line FROM g""",
)
def _(s, d):
    return lines.merge_continuations(doc_lines(s, d))


@query(
    "data_sections",
    f"""WITH {TRIMMED}, p AS (SELECT doc_id, line_no, NOT regexp_matches(lower(line), '{"|".join(lines.NO_PRICES)}')
 AND len(regexp_extract_all(line, '[\\d,]+\\.?\\d*')) >= 2 AND (regexp_matches(line, '[$€£¥]') OR len(list_filter(regexp_extract_all(line, '[\\d,]+\\.?\\d*'), lambda x: regexp_matches(x, '\\.\\d{{0,2}}$'))) > 0
 OR (len(regexp_extract_all(line, '[\\d,]+\\.?\\d*')) >= 3 AND regexp_matches(lower(line), 'qty|quantity|pcs|ea|each|units'))) AS priced
 FROM t WHERE line <> ''), i AS (SELECT *, sum(CASE WHEN priced THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island, max(line_no) OVER (PARTITION BY doc_id) AS last FROM p),
 r AS (SELECT doc_id, island, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines, max(last) AS last FROM i WHERE priced GROUP BY 1, 2)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_line))::INTEGER AS section, first_line, last_line, n_lines FROM r WHERE n_lines >= 2 OR last_line = last""",
)
def _(s, d):
    return lines.data_sections(doc_lines(s, d))


@query(
    "quote_groups_runlength",
    """WITH o AS (SELECT item_id, doc_id, line_no, unit_price, row_number() OVER w AS n, lag(unit_price) OVER w AS before FROM quote_items WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, item_id)),
 r AS (SELECT *, sum(CASE WHEN n > 1 AND before IS NOT DISTINCT FROM unit_price THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no, item_id) AS run FROM o)
 SELECT doc_id, run::BIGINT AS run, min(line_no) AS first_line, count(*) AS n_items FROM r GROUP BY 1, 2""",
)
def _(s, d):
    t = lines.run_groups(table(s, d, "quote_items").select("item_id", "doc_id", "line_no", "unit_price"), "unit_price", ["line_no", "item_id"])
    return t.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_items"))


@query(
    "component_merge",
    f"""WITH {TRIMMED}, p AS (SELECT *, line <> '' AND (regexp_matches(line, '€\\s*\\d') OR regexp_full_match(line, '\\d+') OR regexp_matches(lower(line), 'machin|steel|plate|bracket|housing|assembly') OR regexp_matches(line, '[A-Za-z]+\\d|\\d+[A-Za-z]')) AS part FROM t),
 i AS (SELECT *, sum(CASE WHEN part THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM p)
 SELECT doc_id, min(line_no) AS first_line, count(*)::INTEGER AS n_lines, string_agg(line, ' ' ORDER BY line_no) AS text FROM i WHERE part GROUP BY doc_id, island""",
)
def _(s, d):
    return lines.merge_components(doc_lines(s, d))


@query(
    "document_structure",
    f"WITH {LINES} SELECT doc_id, len(regexp_extract_all(line, {literal(P.NUMBER)}))::INTEGER AS figures, count(*) AS n_lines, min(line_no) AS first_line FROM l GROUP BY 1, 2",
)
def _(s, d):
    return lines.structure(doc_lines(s, d))


@query("lookahead_combine")
def _(s, d):
    return lines.look_ahead(doc_lines(s, d))


@query("column_detection")
def _(s, d):
    return lines.columns(doc_lines(s, d))


@query("text_regions")
def _(s, d):
    return lines.regions(doc_lines(s, d))


SIGN = "[$€£¥₹]"
SUMMARY_LINE = "|".join(p for _, p in P.ADJUSTMENTS)
#: The items of each line in SQL: every candidate is a row, and the first by level, kind and place is taken.
PARSED = rf"""k AS (SELECT doc_id, line_no, line, regexp_extract_all(line, {literal(P.TOKEN)}) AS raw, regexp_split_to_array(line, {literal(P.TOKEN)}) AS gap FROM t
 WHERE NOT regexp_matches(lower(line), {literal(P.SKIP_PATTERN)}) AND len(regexp_extract_all(line, {literal(P.TOKEN)})) >= 2),
 tk AS (SELECT doc_id, line_no, line, len(raw) AS n, unnest(range(1, len(raw) + 1)) AS i, unnest(raw) AS raw, unnest(list_transform(range(1, len(raw) + 1), lambda i: list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(raw[1:i - 1], lambda x: length(x))), 0)::BIGINT)) AS s FROM k),
 tl AS (SELECT *, s + length(raw) AS e, CASE WHEN regexp_full_match(raw, '\d{{1,6}}') THEN raw::INTEGER END AS q, try_cast(CASE WHEN regexp_matches(raw, '[.,]\d{{2}}$') THEN regexp_replace(raw, '[.,]', '', 'g') ELSE regexp_replace(raw, '[.,]', '', 'g') || '00' END AS BIGINT) AS c0,
  substr(line, greatest(s - 3, 1), least(s, 4)) AS before, substr(line, s + length(raw) + 1, 4) AS behind FROM tk),
 tm AS (SELECT *, CASE WHEN regexp_matches(line, '-{SIGN}?\s?\d') AND regexp_matches(before, '(?:^|[\s(:])-{SIGN}?\s?$|{SIGN}\s?-$') THEN -c0 ELSE c0 END AS c,
  (regexp_matches(raw, '[.,]\d{{2}}$') AND q IS NULL) OR regexp_matches(before, '{SIGN}\s?-?$') OR (regexp_matches(behind, '^\s?{SIGN}') AND NOT regexp_matches(behind, '^\s?{SIGN}\s?[-\d]')) AS amount, starts_with(ltrim(behind, ' '), '%') AS percent FROM tl),
 ln AS (SELECT doc_id, line_no, line, any_value(n) AS n, list({{'s': s, 'e': e, 'q': q, 'c': c, 'amount': amount, 'percent': percent}} ORDER BY i) AS t FROM tm GROUP BY 1, 2, 3),
 cand AS (SELECT doc_id, line_no, line, n, t, 3 AS kind, i - 1 AS i, t[i] AS a, t[i + 1] AS b, t[i + 2] AS z, 0 AS l, t[i].s AS r, t[i + 2].e AS stop FROM (SELECT *, unnest(range(1, n - 1)) AS i FROM ln WHERE n >= 3)
  UNION ALL SELECT doc_id, line_no, line, n, t, 2, 0, t[1], t[n - 1], t[n], t[1].e, t[n - 1].s, length(line) FROM ln WHERE n >= 3
  UNION ALL SELECT doc_id, line_no, line, n, t, 1, 0, t[n - 1], t[n - 2], t[n], 0, t[n - 2].s, length(line) FROM ln WHERE n >= 3),
 f1 AS (SELECT *, abs(a.q::HUGEINT * b.c - z.c) AS gap, a.q::HUGEINT * b.c AS product FROM cand WHERE a.q BETWEEN 1 AND 100000 AND b.c <> 0 AND z.c <> 0),
 f2 AS (SELECT doc_id, line_no, line, CASE WHEN gap <= 1 THEN 1 ELSE 0 END AS level, kind, i, a.q AS q, b.c AS p, z.c AS total, l, r, stop FROM f1
   WHERE (gap <= 1 OR 10.0 * gap <= abs(z.c)) AND (kind = 3 OR (b.amount AND z.amount) OR (gap <= 1 AND (b.amount OR z.amount)))
  UNION ALL SELECT doc_id, line_no, line, -1, 3, i, a.q, b.c, z.c, l, r, stop FROM f1 WHERE kind = 3 AND i = n - 3 AND (gap <= 50 OR gap <= 0.15 * abs(product)) AND ((b.amount AND z.amount) OR (gap <= 1 AND (b.amount OR z.amount)))),
 rest AS (SELECT doc_id, line_no, line, t, t[1] AS a, t[2] AS b, t[n - 1] AS y, t[n] AS z FROM ln WHERE NOT regexp_matches(lower(line), {literal(SUMMARY_LINE)})),
 f3 AS (SELECT doc_id, line_no, line, -2 AS level, 0 AS kind, 0 AS i, CASE WHEN counted THEN a.q ELSE 1 END AS q, CASE WHEN counted THEN b.c ELSE a.c END AS p, CASE WHEN counted THEN a.q * b.c ELSE a.c END AS total, 0 AS l, a.s AS r, length(line) AS stop
   FROM (SELECT *, coalesce(a.q BETWEEN 1 AND 100000 AND NOT a.amount AND NOT a.percent AND b.c <> 0, FALSE) AS counted FROM rest)
   WHERE (regexp_matches(lower(line), '\b(?:{'|'.join(P.DISCOUNT)})s?\b') OR (length(line) <= 50 AND len(list_filter(t, lambda x: x.c < 0)) > 0)) AND a.s > 0 AND b.amount AND regexp_matches(substr(line, a.e + 1, b.s - a.e), '^(?:\s|{SIGN}|-)*$') AND (counted OR (a.amount AND a.c <> 0))
  UNION ALL SELECT doc_id, line_no, line, -3, 0, 0, CASE WHEN y.c > 0 AND round_even(z.c::DOUBLE / y.c, 0) BETWEEN 1 AND 100000 AND abs(round_even(z.c::DOUBLE / y.c, 0) * y.c - z.c) <= 0.05 * abs(z.c) THEN round_even(z.c::DOUBLE / y.c, 0)::INTEGER ELSE 1 END, y.c, z.c, 0, y.s, length(line)
   FROM rest WHERE z.amount AND y.amount AND regexp_matches(substr(line, y.e + 1, z.s - y.e), '^(?:\s|{SIGN}|-)*$') AND regexp_matches(substr(line, z.e + 1, 8), '^(?:\s|{SIGN})*$') AND y.c <> 0 AND z.c <> 0 AND regexp_matches(substr(line, 1, y.s), '\pL{{2}}')),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY level DESC, kind DESC, i DESC, q DESC, p DESC, total DESC) AS place FROM (SELECT * FROM f2 UNION ALL SELECT * FROM f3)),
 d AS (SELECT *, trim(substr(line, l + 1, r - l), ' ') AS before, trim(substr(line, stop + 1), ' ') AS behind FROM b WHERE place = 1),
 items AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(CASE WHEN before <> '' AND behind <> '' AND length(behind) < 100 AND regexp_matches(lower(behind), '{'|'.join(P.TRAILING_WORDS)}') THEN before || ' ' || behind ELSE before END, '[^\pL\pM\pN\s_:\-]', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS description,
 q::INTEGER AS quantity, p::DOUBLE / 100 AS unit_price, total::DOUBLE / 100 AS cost FROM d)"""


@query("parsed_items", f"WITH {TRIMMED}, {PARSED} SELECT * FROM items")
def _(s, d):
    return parsing.parse_quotes(docs(s, d))


@query(
    "quote_summary",
    f"""WITH {TRIMMED}, {PARSED}, g AS (SELECT doc_id, quantity, count(*) AS n, sum(unit_price) AS unit_price, sum(cost) AS cost FROM items GROUP BY 1, 2)
 SELECT doc_id, sum(quantity::BIGINT * n)::BIGINT AS total_quantity, round(sum(unit_price), 2) AS total_unit_price_sum, round(sum(cost), 2) AS total_cost, count(*) AS number_of_groups FROM g GROUP BY 1""",
)
def quote_summary(s, d):
    t = parsing.summarize(docs(s, d))
    return t.withColumns({c: F.round(c, 2) for c in ("total_unit_price_sum", "total_cost")})


@query(
    "quote_groups_by_quantity",
    f"""WITH {ITEMS} SELECT doc_id, quantity, count(*) AS n_items, coalesce(quantity, 1)::BIGINT * count(*) AS group_quantity, round(sum(unit_price), 2) AS unit_price, round(sum(cost), 2) AS total_price FROM i GROUP BY doc_id, quantity""",
)
def _(s, d):
    return grouping.by_quantity(typed_items(s, d)).withColumns({c: F.round(c, 2) for c in ("unit_price", "total_price")})


@query(
    "quote_groups_by_price",
    f"""WITH {ITEMS}, g AS (SELECT doc_id, quantity, unit_price, count(*) AS n_items, round(sum(cost), 2) AS cost, min(line_no) AS first FROM i GROUP BY 1, 2, 3)
 SELECT doc_id, quantity, unit_price, n_items, cost, (row_number() OVER (PARTITION BY doc_id ORDER BY first, quantity NULLS FIRST, unit_price NULLS FIRST))::INTEGER AS place FROM g""",
)
def _(s, d):
    return grouping.by_quantity_and_price(typed_items(s, d)).withColumn("cost", F.round("cost", 2))


@query(
    "quote_dedup_exact",
    """SELECT item_id, doc_id FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY doc_id, lower(trim(description, ' ')), unit_price ORDER BY line_no, item_id) AS n FROM quote_items) WHERE n = 1""",
)
def _(s, d):
    return grouping.without_exact_copies(table(s, d, "quote_items"), ["line_no", "item_id"]).select("item_id", "doc_id")


@query("quote_dedup_fuzzy")
def _(s, d):
    return grouping.without_near_copies(typed_items(s, d))


@query(
    "noise_item_removal",
    f"""WITH {ITEMS} SELECT doc_id, count(*) AS n_items, round(sum(cost), 2) AS total_cost FROM i WHERE description IS NOT NULL AND NOT regexp_matches(lower(description), '\\b(?:{"|".join(grouping.NOISE_WORDS)})\\b') AND regexp_matches(description, '[A-Za-z]{{3,}}') GROUP BY 1""",
)
def _(s, d):
    t = grouping.without_noise(typed_items(s, d))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("cost"), 2).alias("total_cost"))


@query("total_quantity", f"WITH {ITEMS} SELECT doc_id, sum(coalesce(quantity, 1))::BIGINT AS total_quantity FROM i GROUP BY 1")
def _(s, d):
    return typed_items(s, d).groupBy("doc_id").agg(F.sum(F.coalesce("quantity", F.lit(1))).alias("total_quantity"))


@query("unread_amounts")
def _(s, d):
    t = read_items(s, d).select("item_id", "doc_id", F.explode("unread").alias("u"))
    return t.select("item_id", "doc_id", "u.field", "u.text")


@query(
    "currency_basic",
    "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN contains(text, '$') THEN 'USD' WHEN contains(text, '€') THEN 'EUR' WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '¥') THEN 'JPY' WHEN contains(text, '₹') THEN 'INR' ELSE 'USD' END AS currency FROM documents",
)
def _(s, d):
    return docs(s, d).select("doc_id", currency.first_symbol(F.col("text")).alias("currency"))


@query(
    "currency_vote",
    r"""WITH v AS (SELECT doc_id, unnest([{'n': len(regexp_extract_all(text, '(?:\$|\bUSD)\s*[\d,.]+')), 'k': 0, 'c': 'USD'}, {'n': len(regexp_extract_all(text, '(?:\€|\bEUR)\s*[\d,.]+')), 'k': -1, 'c': 'EUR'},
 {'n': len(regexp_extract_all(text, '(?:\£|\bGBP)\s*[\d,.]+')), 'k': -2, 'c': 'GBP'}, {'n': len(regexp_extract_all(text, '(?:\¥|\bJPY)\s*[\d,.]+')), 'k': -3, 'c': 'JPY'}, {'n': len(regexp_extract_all(text, '(?:\₹|\bINR)\s*[\d,.]+')), 'k': -4, 'c': 'INR'}]) AS x FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, arg_max(x.c, x.n * 10 + x.k) AS currency, max(x.n)::INTEGER AS votes FROM v GROUP BY 1 HAVING max(x.n) > 0""".replace("\\€", "€").replace("\\£", "£").replace("\\¥", "¥").replace("\\₹", "₹"),
)
def _(s, d):
    return currency.vote(docs(s, d))


@query(
    "cid_ratio",
    "SELECT doc_id, len(regexp_extract_all(text, 'cid:'))::INTEGER AS n_cid, len(regexp_extract_all(text, 'cid:'))::DOUBLE / length(text) AS cid_share, len(regexp_extract_all(text, 'cid:'))::DOUBLE / length(text) > 0.05 AS garbled FROM documents WHERE length(text) > 0",
)
def _(s, d):
    return currency.cid_share(docs(s, d))


@query(
    "currency_format",
    "SELECT doc_id, method, CASE WHEN method = 'template' THEN printf('%.2f', total_cost) || ' €' ELSE '$' || printf('%.2f', total_cost) END AS written FROM method_results",
)
def _(s, d):
    code = F.when(F.col("method") == "template", "EUR").otherwise("USD")
    return table(s, d, "method_results").select("doc_id", "method", currency.written(F.col("total_cost"), code).alias("written"))


def _adjustment_sql() -> str:
    kinds = " ".join(f"WHEN regexp_matches(low, {literal(p)}) THEN '{k}'" for k, p in P.ADJUSTMENTS)
    raws = " ".join(f"WHEN regexp_matches(low, {literal(p)}) THEN regexp_extract(low, {literal(p)}, 1)" for k, p in P.ADJUSTMENTS)
    number = """round_even(try_cast(CASE WHEN contains(x, ',') AND contains(x, '.') AND instr(reverse(x), ',') < instr(reverse(x), '.') THEN replace(replace(x, '.', ''), ',', '.')
 WHEN contains(x, ',') AND NOT contains(x, '.') AND regexp_matches(x, ',\\d{0,2}$') THEN replace(x, ',', '.') ELSE replace(x, ',', '') END AS DECIMAL(18,4)), 2)::DOUBLE"""
    return f"{LINES}, a0 AS (SELECT doc_id, line_no, lower(trim(line, ' ')) AS low FROM l), a1 AS (SELECT doc_id, line_no, CASE {kinds} END AS kind, CASE {raws} END AS x FROM a0), a AS (SELECT doc_id, line_no, kind, {number} AS value FROM a1 WHERE kind IS NOT NULL)"


@query("summary_adjustments", f"WITH {_adjustment_sql()} SELECT * FROM a")
def _(s, d):
    return adjustments.extract(doc_lines(s, d))


@query(
    "final_total",
    f"""WITH RECURSIVE {_adjustment_sql()}, t AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM l), {PARSED},
 costs AS (SELECT doc_id, round(sum(cost) * 100)::BIGINT AS cost FROM items GROUP BY 1),
 o AS (SELECT doc_id, kind, round(value * 100)::BIGINT AS v, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'subtotal' THEN 1 WHEN 'tax_amount' THEN 2 WHEN 'tax_percentage' THEN 2 WHEN 'shipping' THEN 3 WHEN 'handling' THEN 3 WHEN 'freight' THEN 3 WHEN 'total' THEN 5 ELSE 4 END, line_no) AS n FROM a WHERE value IS NOT NULL),
 r AS (SELECT doc_id, cost, cost AS running, 0::BIGINT AS n FROM costs UNION ALL
  SELECT r.doc_id, r.cost, CASE WHEN kind IN ('subtotal', 'total') THEN v WHEN kind = 'tax_percentage' THEN running + (running * v + 5000) // 10000 WHEN kind = 'discount_percentage' THEN running - (running * v + 5000) // 10000 WHEN kind = 'discount_amount' THEN running - v ELSE running + v END, o.n FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1)
 SELECT doc_id, arg_max(cost, n)::DOUBLE / 100 AS subtotal, arg_max(running, n)::DOUBLE / 100 AS final_total, max(n)::INTEGER AS n_applied FROM r GROUP BY 1""",
)
def _(s, d):
    return parsing.final_totals(docs(s, d))


@query(
    "extraction_quality",
    rf"""WITH {LINES}, x AS (SELECT doc_id, line, len(regexp_extract_all(line, '[\d,]+\.?\d*')) AS n, lower(line) AS low FROM l WHERE trim(line, ' ') <> '' AND 10 * len(regexp_extract_all(line, 'cid:')) <= 3 * len({WORDS.format('line')})),
 p AS (SELECT doc_id, n >= 3 AS is_row, n = 2 AND contains(line, '$') AS near, regexp_matches(low, '{"|".join(P.QUALITY_WORDS)}') AS word, regexp_matches(upper(line), '[A-Z]+-\d+') AS part FROM x),
 g AS (SELECT doc_id, sum((CASE WHEN is_row THEN 20 WHEN near THEN 15 ELSE 0 END) + (CASE WHEN word THEN 5 ELSE 0 END) + (CASE WHEN part THEN 10 ELSE 0 END)) AS points,
  sum((CASE WHEN is_row THEN 10 WHEN near THEN 8 ELSE 0 END) + (CASE WHEN word THEN 3 ELSE 0 END) + (CASE WHEN part THEN 5 ELSE 0 END)) AS readable, sum(CASE WHEN is_row OR near THEN 1 ELSE 0 END) AS items FROM p GROUP BY 1),
 b AS (SELECT doc_id, 50 * len(regexp_extract_all(text, 'cid:')) + 25 * len(regexp_extract_all(text, 'glyph|unicode|�|\?{{6}}')) AS bad FROM documents WHERE length(text) > 0)
 SELECT doc_id, coalesce(items, 0)::BIGINT AS item_lines, greatest(coalesce(points, 0) + CASE WHEN items >= 2 THEN 30 WHEN items >= 1 THEN 10 ELSE 0 END + CASE WHEN readable > 20 THEN 20 ELSE 0 END - bad, -500)::BIGINT AS score FROM b LEFT JOIN g USING (doc_id)""",
)
def _(s, d):
    return classify.extraction_quality(doc_lines(s, d), docs(s, d))


SCORE_B = "least(10 + least(5 * coalesce(n_items, 0), 50) + greatest(least(coalesce(total_cost::DOUBLE, 0) / 100, 20), 0) + 5 * coalesce(n_adjustments, 0) + CASE WHEN n_items > 0 AND total_cost > 0 THEN 10 ELSE 0 END, 100)"


@query("result_score", f"SELECT doc_id, method, {SCORE_B}::DOUBLE AS score FROM method_results")
def _(s, d):
    t = table(s, d, "method_results")
    return t.select("doc_id", "method", scoring.result_score(F.col("n_items"), F.col("total_cost"), F.col("n_adjustments")).alias("score"))


@query(
    "best_method",
    f"""WITH m AS (SELECT doc_id, method, method_rank, {SCORE_B}::DOUBLE AS score FROM method_results)
 SELECT doc_id, method, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN score >= 70 THEN 0 ELSE 1 END, CASE WHEN score >= 70 THEN method_rank END, score DESC, method_rank) AS n FROM m) WHERE n = 1""",
)
def _(s, d):
    t = table(s, d, "method_results").withColumn("score", scoring.result_score(F.col("n_items"), F.col("total_cost"), F.col("n_adjustments")))
    return scoring.best(t, "score", accept=70).select("doc_id", "method", "score")


@query(
    "quality_score",
    f"""WITH {ITEMS}, g AS (SELECT doc_id, count(*) AS n, sum((CASE WHEN trim(description, ' ') <> '' THEN 1 ELSE 0 END) + (CASE WHEN quantity IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN unit_price IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN cost IS NOT NULL THEN 1 ELSE 0 END)) AS filled,
 sum(CASE WHEN unit_price > 50 THEN 20 WHEN unit_price > 10 THEN 10 ELSE 0 END) AS price, coalesce(round(sum(cost), 2), 0) AS total, sum(CASE WHEN contains(lower(description), 'cid:') THEN 50 ELSE 0 END) AS cid FROM i GROUP BY 1)
 SELECT doc_id, n AS n_items, least(greatest(20 + least(15 * n, 75) - CASE WHEN n <= 1 THEN 50 ELSE 0 END + 2.5 * filled - cid, 0) + CASE WHEN total > 1000 THEN 100 WHEN total > 100 THEN 50 ELSE 0 END + price - CASE WHEN total < 50 THEN 50 ELSE 0 END, 200)::DOUBLE AS score FROM g""",
)
def _(s, d):
    return scoring.quality_score(typed_items(s, d))


@query(
    "totals_agree",
    f"""WITH {ITEMS}, g AS (SELECT doc_id, round(sum(cost), 2) AS c FROM i GROUP BY 1) SELECT doc_id, coalesce(c, 0) AS item_cost, total_cost::DOUBLE AS stated_cost, abs(coalesce(c, 0) - total_cost::DOUBLE) <= 1.0 AS agrees FROM quote_summary LEFT JOIN g USING (doc_id)""",
)
def _(s, d):
    stated = table(s, d, "quote_summary").select("doc_id", F.col("total_cost").cast("double").alias("stated_cost"))
    items = typed_items(s, d).groupBy("doc_id").agg(F.round(F.sum("cost"), 2).alias("cost"))
    return scoring.totals_agree(items, stated)


@query("permutation_match")
def _(s, d):
    return parsing.permutation_match(doc_lines(s, d))


@query("results_json")
def _(s, d):
    return parsing.results(docs(s, d)).select("doc_id", F.to_json(F.struct("summary", "groups")).alias("json"))


@query(
    "stream_arrivals",
    """SELECT time_bucket(INTERVAL 7 days, received_at, TIMESTAMP '1970-01-01 00:00:00') AS window_start, source, count(*) AS n_docs FROM documents WHERE received_at IS NOT NULL GROUP BY 1, 2""",
)
def _(s, d):
    # the whole table, laid down in the shared folder, as a stream; complete mode, for the last windows are still open
    where = own_path(s, "stream")
    arrivals = table(s, d, "documents").select("received_at", "source")
    arrivals.write.parquet(f"{where}/in")
    stream = ingest.arriving(s, f"{where}/in", arrivals.schema)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out")

    q = ingest.arrivals_by_window(stream, "received_at").writeStream.foreachBatch(keep).option("checkpointLocation", f"{where}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{where}/out")
