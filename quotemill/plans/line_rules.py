"""Queries of the line, text and price rules over whole tables, each with the same rules in SQL of another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill import patterns as P
from quotemill.operators import adjustments, cleanup, descriptions, filters, grouping, lines, numbers, parsing, prices, scoring
from quotemill.plans import money_sql
from quotemill.plans.quotes import LINES, NOISE, ORACLE, PARSED, TRIMMED, WORDS, _adjustment_sql, doc_lines, docs, literal, query, table, typed_items


def trimmed(s, d):
    return doc_lines(s, d).withColumn("line", F.trim("line"))


def has(text: str, terms: list[str]) -> str:
    return " + ".join(f"contains({text}, {literal(t)})::INTEGER" for t in terms)


def word(text: str, terms: list[str]) -> str:
    return " + ".join(f"regexp_matches({text}, {literal(P.LEFT + t + P.RIGHT)})::INTEGER" for t in terms)


def m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {literal(pattern)})"


def any_word(text: str, terms: list[str]) -> str:
    return m(text, "|".join(terms))


LEFT = WORDS.format(f"trim(regexp_replace(trim(regexp_replace(line, {literal(P.FIGURE_SIGNS)}, '', 'g'), ' '), {literal(P.MARK)}, ' ', 'g'), ' ')")


@query(
    "address_lines",
    f"""WITH {TRIMMED}, a AS (SELECT doc_id, line_no, line, lower(line) AS low FROM t), h AS (SELECT *, {has('low', P.ADDRESS_LONG)} + {word('low', P.ADDRESS_SHORT)} AS n, {has('low', P.REACH_LONG)} + {word('low', P.REACH_SHORT)} AS r FROM a)
 SELECT doc_id, line_no FROM h WHERE (n > 0 AND ({m('line', P.ZIP)} OR {m('low', P.STREET)} OR {m('low', P.SUITE)} OR n >= 2)) OR ({any_word('low', P.REACH_LONG + P.REACH_SHORT)} AND ({m('line', P.PHONE)} OR {m('line', P.EMAIL)} OR {m('low', P.SITE)}))
 OR ({any_word('low', P.COMPANY)} AND NOT {any_word('low', P.PRODUCT_WORDS)}) OR (len({LEFT}) <= 2 AND (n > 0 OR r > 0)) OR {m('low', P.STREET_FIRST)} OR {m('line', P.CITY)}""",
)
def _(s, d):
    return trimmed(s, d).where(filters.is_address(F.col("line"))).select("doc_id", "line_no")


@query("basic_products", f"SELECT item_id FROM quote_items WHERE length(trim(description, ' ')) >= 3 AND NOT {m(chr(108) + 'ower(trim(description, chr(32)))', P.NO_PRODUCT)}")
def _(s, d):
    return table(s, d, "quote_items").where(filters.is_product(F.col("description"))).select("item_id")


MULTI = f"({m('line', r'\d+(?:,\d{3})*(?:\.\d{2})?')} OR {m('lower(line)', P.COUNTED)} OR {m('lower(line)', P.PRODUCT_TERMS)})"


@query("likely_items_multi_format", f"WITH {TRIMMED} SELECT doc_id, line_no FROM t WHERE {MULTI}")
def _(s, d):
    return trimmed(s, d).where(filters.is_item_multi_format(F.col("line"))).select("doc_id", "line_no")


@query(
    "multi_format_lines",
    f"""WITH {TRIMMED} SELECT doc_id, line_no, line FROM t WHERE length(line) >= 3 AND {MULTI} AND NOT ({' OR '.join(m('line', p) for p in (P.ANY_PHONE, P.ANY_ADDRESS, P.ANY_CONTACT, P.ANY_METADATA, P.LABEL_ONLY, r'^[-=_*]{3,}$'))}) AND {m('line', r'[\p{L}\p{N}_]')}""",
)
def _(s, d):
    return filters.multi_format_lines(doc_lines(s, d))


@query(
    "template_lines",
    f"""WITH {TRIMMED} SELECT doc_id, line_no, line FROM t WHERE length(line) >= 5 AND length(regexp_replace(line, {literal(P.MARK)}, '', 'g')) >= 3
 AND NOT ({' OR '.join(m('line', p) for p in (P.PHONE_ONLY, P.ADDRESS_ONLY, P.CONTACT_FIRST, P.METADATA_FIRST, P.HEADER_ONLY, r'^[-=_]{3,}$'))})
 AND ({m('line', r'\d+[.,]\d{2}')} OR {m('line', r'^\d+\s+')} OR {m('line', P.TEMPLATE_PRODUCT)} OR ({m('line', '[A-Za-z]')} AND {m('line', chr(92) + 'd')}))""",
)
def _(s, d):
    return filters.template_lines(doc_lines(s, d))


@query(
    "likely_item_lines",
    f"""WITH {TRIMMED} SELECT doc_id, line_no FROM t WHERE length(line) BETWEEN 10 AND 200 AND NOT {m('lower(line)', P.NO_ITEM_FIRST)} AND {m('line', chr(92) + 'd')} AND {m('line', '[A-Za-z]')} AND ({m('line', P.CURRENCY_SIGN)} OR {m('line', r'\d+[.,]\d{2}|\d+\s+\d+|\d{3,}')})""",
)
def _(s, d):
    return doc_lines(s, d).where(filters.is_item_line(F.col("line"))).select("doc_id", "line_no")


@query(
    "valid_items",
    f"""WITH {money_sql.TYPED}, x AS (SELECT *, trim(description, ' ') AS t, lower(trim(description, ' ')) AS low FROM i), w AS (SELECT *, {WORDS.format('low')} AS w FROM x)
 SELECT item_id FROM w WHERE length(t) >= 5 AND NOT {m('t', P.CODE_NOISE)} AND NOT {m('low', P.METADATA_FIRST_WORDS)} AND NOT {m('t', r'^[\d\s.,\-+]+$')} AND 2 * len(list_filter(w, lambda z: length(z) = 1)) <= len(w)
 AND 10 * length(regexp_replace(t, '[\\pL\\pM\\pN\\s]', '', 'g')) <= 3 * length(t) AND quantity > 0 AND unit_price > 0 AND cost > 0 AND abs(quantity * unit_price - cost) <= greatest(0.01, cost * 0.02)""",
)
def _(s, d):
    return typed_items(s, d).where(filters.is_valid_item(*(F.col(c) for c in ("description", "quantity", "unit_price", "cost")))).select("item_id")


@query(
    "valid_results",
    """WITH g AS (SELECT doc_id, count(*) AS n_groups FROM quote_groups GROUP BY 1), i AS (SELECT doc_id, count(*) AS n_items FROM quote_items GROUP BY 1)
 SELECT doc_id, coalesce(n_groups, 0) AS n_groups, coalesce(n_items, 0) AS n_items, coalesce(n_groups, 0) > 0 AND coalesce(n_items, 0) > 0 AS is_valid FROM g FULL JOIN i USING (doc_id)""",
)
def _(s, d):
    return filters.valid_results(table(s, d, "quote_groups"), table(s, d, "quote_items"))


def replaced(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(by)}, 'g')"
    return text


SPACES = (r"\s+", " ")


@query(
    "final_descriptions",
    f"WITH x AS (SELECT item_id, trim({replaced('description', *((f'(?i){p}', '') for p in P.TEST_PHRASES), (r'\s+and\s+[1-9]\s*$', ''), (r'\s+,\s*[1-9]\s*$', ''), SPACES)}, ' ') AS t FROM quote_items) SELECT item_id, CASE WHEN length(t) < 3 THEN '' ELSE t END AS description FROM x",
)
def _(s, d):
    return table(s, d, "quote_items").select("item_id", cleanup.final_description(F.col("description")).alias("description"))


@query(
    "uncorrupted_descriptions",
    f"WITH x AS (SELECT item_id, description AS raw, trim({replaced('description', *((f'(?i){p}', '') for p in P.CORRUPTED), SPACES)}, ' ') AS t FROM quote_items) SELECT item_id, CASE WHEN len({WORDS.format('raw')}) < 2 THEN raw WHEN length(t) < 3 THEN '' ELSE t END AS description FROM x",
)
def _(s, d):
    return table(s, d, "quote_items").select("item_id", cleanup.uncorrupted(F.col("description")).alias("description"))


CLEAN = f"trim({replaced('line', (r'[\x00-\x1f\x7f]', ''), *((f'(?i){p}', '') for p in P.PAGE_NOISE), (P.KEPT_SIGNS, ''), (P.RARE_CURRENCY, '€'), SPACES)}, ' ')"


@query("clean_lines", f"WITH {LINES}, c AS (SELECT doc_id, line_no, {CLEAN} AS line FROM l), w AS (SELECT *, {WORDS.format('line')} AS w FROM c WHERE length(line) > 2) SELECT doc_id, line_no, line FROM w WHERE {NOISE} < 7")
def _(s, d):
    return cleanup.clean_lines(doc_lines(s, d))


@query(
    "artifact_cleanup",
    f"""WITH x AS (SELECT doc_id, {replaced('text', ('<0a>', chr(10)), ('<[0-9a-f]{2}>', ''), (r'(?s)Internal Error:.*?\.', ''), (r'(?s)Cannot handle URI.*?\.', ''), (r'\b[A-Za-z]{20,}\b', ''), ('\r\n?', chr(10)))} AS text FROM documents WHERE text IS NOT NULL),
 y AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM x), z AS (SELECT doc_id, unnest(range(len(p)))::INTEGER AS line_no, trim(regexp_replace(unnest(p), '\\s+', ' ', 'g'), ' ') AS line FROM y)
 SELECT * FROM z WHERE line <> '' AND 10 * length(regexp_replace(line, '[^\\pL\\pN]', '', 'g')) > 3 * length(line)""",
)
def _(s, d):
    return cleanup.without_artifacts(docs(s, d))


def pages(s, d):
    """Two readings of each page of forty lines: as it is, and with misread digits put right."""
    raw = doc_lines(s, d).withColumn("page_no", F.floor(F.col("line_no") / 40).cast("int") + 1)
    fixed = raw.withColumn("line", lines.repair_digits(F.col("line")))
    return raw.withColumn("method", F.lit("as_read")).unionByName(fixed.withColumn("method", F.lit("digits_repaired"))).select("doc_id", "page_no", "method", "line")


PAGES = f"""{LINES}, pg AS (SELECT doc_id, line_no // 40 + 1 AS page_no, 'as_read' AS method, line FROM l UNION ALL SELECT doc_id, line_no // 40 + 1, 'digits_repaired', array_to_string(list_transform({WORDS.format('line')},
 lambda w: CASE WHEN regexp_full_match(w, '[$0-9.,\\-OlI§S]+') THEN translate(w, 'OlIS§', '01155') ELSE w END), ' ') FROM l),
 sc AS (SELECT doc_id, page_no::INTEGER AS page_no, method, sum(CASE WHEN t = '' THEN 0 ELSE (CASE WHEN len(regexp_extract_all(t, '[\\d,]+\\.?\\d*')) >= 2 THEN 10 ELSE 0 END) + (CASE WHEN contains(t, '$') THEN 5 ELSE 0 END) + (CASE WHEN regexp_matches(lower(t), 'qty|quantity|service|product') THEN 3 ELSE 0 END)
  - (CASE WHEN 10 * (length(t) - length(regexp_replace(t, {literal(P.ODD_SIGNS)}, '', 'g'))) > length(t) THEN length(t) - length(regexp_replace(t, {literal(P.ODD_SIGNS)}, '', 'g')) ELSE 0 END) END)::BIGINT AS score FROM (SELECT *, trim(line, ' ') AS t FROM pg) GROUP BY 1, 2, 3)"""


@query("best_pages", f"WITH {PAGES} SELECT doc_id, page_no, method, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY score DESC, method) AS n FROM sc) WHERE n = 1")
def _(s, d):
    return cleanup.best_pages(pages(s, d), ["as_read", "digits_repaired"])


@query("first_pages", f"WITH {PAGES} SELECT * FROM sc WHERE page_no <= 3")
def _(s, d):
    return cleanup.page_scores(cleanup.first_pages(pages(s, d), 3))


@query(
    "combined_items",
    f"""WITH {TRIMMED}, c AS (SELECT doc_id, line_no, line, regexp_extract_all(line, {literal(P.COMBINED)}) AS x FROM t), e AS (SELECT doc_id, line_no, CASE WHEN len(x) > 0 THEN list_transform(x, lambda y: regexp_replace(trim(y, ' '), '^(?:[A-Z]{{2}}\\s+)?\\d{{5}}\\s+', '')) ELSE [line] END AS x FROM c)
 SELECT doc_id, line_no, unnest(range(len(x)))::INTEGER AS place, unnest(x) AS text FROM e""",
)
def _(s, d):
    return cleanup.combined_items(trimmed(s, d))


def value(raw: str) -> str:
    x = f"regexp_replace({raw}, '[^0-9.,\\-]', '', 'g')"
    return f"""(SELECT round_even(try_cast(CASE WHEN contains(x, ',') AND contains(x, '.') AND instr(reverse(x), ',') < instr(reverse(x), '.') THEN replace(replace(x, '.', ''), ',', '.')
 WHEN contains(x, ',') AND NOT contains(x, '.') AND regexp_matches(x, ',\\d{{0,2}}$') THEN replace(x, ',', '.') ELSE replace(x, ',', '') END AS DECIMAL(18,4)), 2)::DOUBLE FROM (SELECT {x} AS x))"""


def placed(pattern: str, columns: str, source: str) -> str:
    """Rows of all matches of a pattern: their number, start, text and first group."""
    p = literal(pattern)
    return f"""SELECT {columns}, unnest(range(len(raw)))::INTEGER AS place, unnest(list_transform(range(1, len(raw) + 1), lambda i: list_sum(list_transform(gap[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(raw[1:i - 1], lambda y: length(y))), 0)::BIGINT))::INTEGER AS start, unnest(raw) AS raw, unnest(g) AS g
 FROM (SELECT {columns}, regexp_extract_all(line, {p}) AS raw, regexp_extract_all(line, {p}, 1) AS g, regexp_split_to_array(line, {p}) AS gap FROM {source})"""


def near(start: str, length: str, reach: int) -> str:
    return f"lower(substr(line, greatest({start} - {reach}, 0) + 1, {start} - greatest({start} - {reach}, 0) + {length} + {reach}))"


KINDS = " UNION ALL ".join(f"SELECT {k} AS kind, * FROM ({placed(f'({p})', 'doc_id, line_no, line', 'l')})" for k, p in enumerate(P.NUMBER_KINDS))


@query(
    "all_number_tokens",
    f"""WITH {LINES}, k AS ({KINDS}) SELECT doc_id, line_no, kind, place, start, raw, {value('raw')} AS value, contains(raw, '$') OR regexp_matches({near('start', 'length(raw)', 10)}, 'price|cost|total|amount') AS is_currency,
 regexp_matches({near('start', 'length(raw)', 10)}, 'qty|quantity|pcs|each|ea') AS is_quantity, contains(raw, '%') AS is_percentage FROM k""",
)
def _(s, d):
    return prices.all_tokens(doc_lines(s, d))


PRICES = " UNION ALL ".join(f"SELECT {k} AS ord, * FROM ({placed(f'(?i){p}', 'doc_id, line_no, line', 't')})" for k, p in enumerate(P.PRICE_KINDS))


@query(
    "price_tokens",
    f"""WITH {TRIMMED}, k AS ({PRICES}), v AS (SELECT *, {value('g')} AS value, {near('start', 'length(raw)', 15)} AS ctx FROM k),
 c AS (SELECT *, least(50 + CASE WHEN regexp_matches(g, '[$€£¥]') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(ctx, 'price|cost|total|amount|rate|fee|charge') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(g, '\\.[^.]{{2}}$') THEN 20 ELSE 0 END + CASE WHEN value BETWEEN 0.01 AND 100000 THEN 10 WHEN value > 100000 THEN -20 ELSE 0 END, 100) AS confidence FROM v WHERE value IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, start, length(raw) ORDER BY confidence DESC, ord) AS n FROM c)
 SELECT doc_id, line_no, start, (start + length(raw))::INTEGER AS stop, g AS raw, value, confidence::INTEGER AS confidence FROM r WHERE n = 1""",
)
def _(s, d):
    return prices.price_tokens(doc_lines(s, d))


UNIT_PRICE = "CASE " + " ".join(f"WHEN {m('line', f'(?i){p}')} THEN {k}" for k, (_, p) in reversed(list(enumerate(P.UNIT_PRICES)))) + " END"
UNIT_RAW = "CASE pattern " + " ".join(f"WHEN {k} THEN regexp_extract(line, {literal(f'(?i){p}')}, 1)" for k, (_, p) in enumerate(P.UNIT_PRICES)) + " END"
UNIT_NAME = "CASE pattern " + " ".join(f"WHEN {k} THEN '{u}'" for k, (u, _) in enumerate(P.UNIT_PRICES)) + " END"


@query("unit_prices", f"WITH {LINES}, u AS (SELECT *, {UNIT_PRICE} AS pattern FROM l), r AS (SELECT *, {UNIT_RAW} AS raw FROM u WHERE pattern IS NOT NULL) SELECT doc_id, line_no, pattern, {UNIT_NAME} AS unit, raw, {value('raw')} AS value, 80 + 2 * pattern AS confidence FROM r")
def _(s, d):
    return prices.unit_prices(doc_lines(s, d))


@query(
    "quantities_of_text",
    """WITH n AS (SELECT doc_id, text, unnest(list_distinct(list_filter(regexp_extract_all(text, '[\\pL\\pN_]+'), lambda w: regexp_full_match(w, '\\d{1,4}')))) AS number FROM documents WHERE text IS NOT NULL), p AS (SELECT *, instr(text, number) - 1 AS pos FROM n)
 SELECT DISTINCT doc_id, number::INTEGER AS quantity FROM p WHERE number::INTEGER >= 1 AND regexp_matches(lower(substr(text, greatest(pos - 30, 0) + 1, pos - greatest(pos - 30, 0) + 30)), 'qty|quantity|price|total|\\$|rate')""",
)
def _(s, d):
    return prices.quantities_of_text(docs(s, d))


@query(
    "stated_totals",
    f"WITH r AS (SELECT doc_id, coalesce({', '.join(f'nullif(regexp_extract(text, {literal(f'(?i){p}')}, 1), {chr(39) * 2})' for p in P.STATED_TOTALS)}) AS raw FROM documents WHERE text IS NOT NULL) SELECT doc_id, {value('raw')} AS total FROM r WHERE raw IS NOT NULL",
)
def _(s, d):
    return prices.stated_total(docs(s, d))


US = "coalesce(try_cast(CASE WHEN regexp_full_match(x, '-?\\d{1,3}(\\.\\d{3})+,\\d{2}') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '') END AS DECIMAL(18,2)), 0)"


@query(
    "locale_prices",
    f"""WITH f AS (SELECT item_id, unit_price AS t, regexp_replace(unit_price, '[^0-9.,\\-]', '', 'g') AS x FROM quote_items), c AS (SELECT *, CASE WHEN regexp_matches(t, '[€₽]') THEN TRUE WHEN regexp_matches(t, '[£¥₹₩$]') THEN FALSE
 WHEN contains(x, ',') THEN CASE WHEN contains(x, '.') THEN length(x) - length(replace(x, ',', '')) = 1 AND regexp_matches(x, ',\\d{{2}}$') ELSE TRUE END ELSE FALSE END AS continental FROM f)
 SELECT item_id, CASE WHEN t IS NULL THEN 0 ELSE coalesce(round_even(try_cast(CASE WHEN continental THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, ',', '') END AS DECIMAL(18,4)), 2), {US})::DOUBLE END AS price FROM c""",
)
def _(s, d):
    return table(s, d, "quote_items").select("item_id", prices.locale_price(F.col("unit_price")).cast("double").alias("price"))


@query(
    "prices_by_currency",
    f"""WITH q AS (SELECT item_id, regexp_replace(unit_price, '\\s+', '', 'g') AS x, CASE amount_unit WHEN 'EUR' THEN 'EUR' WHEN 'KUSD' THEN 'JPY' ELSE 'USD' END AS code FROM quote_items LEFT JOIN quote_summary USING (doc_id) LEFT JOIN feeds USING (feed_id))
 SELECT item_id, CASE WHEN code IN ('{"', '".join(P.COMMA_CURRENCIES)}') THEN CASE WHEN contains(x, ',') THEN replace(replace(x, '.', ''), ',', '.') ELSE replace(x, '.', '') END WHEN code IN ('{"', '".join(P.WHOLE_CURRENCIES)}') THEN regexp_replace(x, '[.,]', '', 'g') ELSE replace(x, ',', '') END AS figure FROM q""",
)
def _(s, d):
    feed = table(s, d, "quote_summary").select("doc_id", "feed_id").join(table(s, d, "feeds").select("feed_id", "amount_unit"), "feed_id", "left").select("doc_id", "amount_unit")
    t = table(s, d, "quote_items").select("item_id", "doc_id", "unit_price").join(feed, "doc_id", "left")
    code = F.when(F.col("amount_unit") == "EUR", "EUR").when(F.col("amount_unit") == "KUSD", "JPY").otherwise("USD")
    return t.select("item_id", prices.by_currency(F.col("unit_price"), code).alias("figure"))


@query("unit_price_from_totals", """WITH x AS (SELECT doc_id, abs(total_cost * 10000)::HUGEINT AS x, sign(total_cost) AS g, total_quantity AS q FROM quote_summary), r AS (SELECT doc_id, q, x, g, x // q + CASE WHEN 2 * (x % q) > q OR (2 * (x % q) = q AND (x // q) % 2 = 1) THEN 1 ELSE 0 END AS f FROM x WHERE q > 0)
 SELECT doc_id, g * (f // 100 + CASE WHEN f % 100 > 50 OR (f % 100 = 50 AND (f // 100) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100 AS unit_price FROM r WHERE x IS NOT NULL UNION ALL SELECT doc_id, CASE WHEN q > 0 THEN NULL ELSE 0.0 END FROM x WHERE q IS NULL OR q <= 0 OR x IS NULL""")
def _(s, d):
    return table(s, d, "quote_summary").select("doc_id", prices.unit_price_of(F.col("total_cost"), F.col("total_quantity")).alias("unit_price"))


EU = "try_cast(CASE WHEN regexp_full_match({0}, '-?\\d{{1,3}}(\\.\\d{{3}})*,\\d{{1,2}}') THEN replace(replace({0}, '.', ''), ',', '.') WHEN regexp_full_match({0}, '-?\\d+,\\d{{1,2}}') THEN replace({0}, ',', '.') WHEN regexp_full_match({0}, '-?\\d{{1,3}}(,\\d{{3}})*(\\.\\d+)?') OR regexp_full_match({0}, '-?\\d+(\\.\\d+)?') THEN replace({0}, ',', '') END AS DECIMAL(18,2))::DOUBLE"
_all = lambda p, k: f"regexp_extract_all(line, {literal(p)}, {k})"


@query(
    "structured_items",
    f"""WITH {TRIMMED}, a AS (SELECT doc_id, line_no, {_all(P.STRUCTURED, 1)} AS d, {_all(P.STRUCTURED, 2)} AS q, {_all(P.STRUCTURED, 3)} AS p, {_all(P.STRUCTURED, 4)} AS z, {_all(P.STRUCTURED_NO_QUANTITY, 1)} AS d2, {_all(P.STRUCTURED_NO_QUANTITY, 2)} AS p2, {_all(P.STRUCTURED_NO_QUANTITY, 3)} AS z2 FROM t),
 b AS (SELECT doc_id, line_no, unnest(range(len(d)))::INTEGER AS place, unnest(d) AS d, unnest(q)::INTEGER AS q, unnest(p) AS p, unnest(z) AS z FROM a WHERE len(d) > 0 UNION ALL SELECT doc_id, line_no, unnest(range(len(d2)))::INTEGER, unnest(d2), NULL, unnest(p2), unnest(z2) FROM a WHERE len(d) = 0),
 c AS (SELECT doc_id, line_no, place, trim(d, ' ') AS description, q, {EU.format('p')} AS unit_price, {EU.format('z')} AS cost FROM b)
 SELECT doc_id, line_no, place, description, coalesce(q, CASE WHEN unit_price > 0 THEN round_even(cost / unit_price, 0)::INTEGER ELSE 1 END) AS quantity, unit_price, cost FROM c WHERE length(description) > 2 AND description NOT IN ('SUBTOTAL', 'TOTAL', 'TAX') AND unit_price IS NOT NULL AND cost IS NOT NULL""",
)
def _(s, d):
    return prices.structured_items(doc_lines(s, d))


_x = lambda p, k: f"regexp_extract(line, {literal(p)}, {k})"
CURRENCY = " ".join(f"WHEN {m('line', p)} THEN {{'n': '{n}', 'd': {_x(p, 1)}, 'q': {_x(p, 2) if c else chr(39) + '1' + chr(39)}, 'p': {_x(p, 3 if c else 2)}, 'z': {_x(p, 4 if c else 3)}}}" for n, p, c in P.CURRENCY_ITEMS)


@query(
    "currency_items",
    f"""WITH {TRIMMED}, a AS (SELECT doc_id, line_no, CASE {CURRENCY} END AS x FROM t), b AS (SELECT doc_id, line_no, x.n AS pattern, trim(x.d, ' ') AS description, coalesce(try_cast(nullif(x.q, '') AS INTEGER), 1) AS quantity, x.p AS p, x.z AS z FROM a WHERE x IS NOT NULL),
 c AS (SELECT *, CASE WHEN starts_with(pattern, 'eur') THEN {EU.format('p')} ELSE try_cast(replace(p, ',', '') AS DECIMAL(18,2))::DOUBLE END AS unit_price, CASE WHEN starts_with(pattern, 'eur') THEN {EU.format('z')} ELSE try_cast(replace(z, ',', '') AS DECIMAL(18,2))::DOUBLE END AS cost FROM b)
 SELECT doc_id, line_no, pattern, description, quantity, unit_price, cost FROM c WHERE length(description) >= 3 AND unit_price IS NOT NULL AND cost IS NOT NULL""",
)
def _(s, d):
    return prices.currency_items(doc_lines(s, d))


THREE = " ".join(f"WHEN {q} BETWEEN 1 AND 10000 AND {p} > 0 AND abs({q} * {p} - {z}) <= 0.0100001 THEN {{'q': {q}, 'p': {p}, 'z': {z}}}" for q, p, z in (("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")))


@query(
    "three_figures",
    f"""WITH {LINES}, v AS (SELECT doc_id, line_no, trim({_x(P.THREE_FIGURES, 1)}, ' ') AS description, {value(_x(P.THREE_FIGURES, 2))} AS a, {value(_x(P.THREE_FIGURES, 3))} AS b, {value(_x(P.THREE_FIGURES, 4))} AS c FROM l WHERE {m('line', P.THREE_FIGURES)}),
 x AS (SELECT *, CASE {THREE} END AS x FROM v) SELECT doc_id, line_no, description, x.q AS quantity, x.p AS unit_price, x.z AS cost FROM x WHERE x IS NOT NULL""",
)
def _(s, d):
    return prices.three_figures(doc_lines(s, d))


@query("robust_items")
def _(s, d):
    return prices.robust_items(doc_lines(s, d))


@query(
    "document_confidence",
    f"""WITH {money_sql.TYPED}, g AS (SELECT doc_id, count(*) AS n, sum(cost) AS cost, sum(CASE WHEN length(description) > 3 AND regexp_matches(description, '[A-Za-z]') THEN 5 ELSE 0 END) AS described FROM i GROUP BY 1)
 SELECT doc_id, coalesce(n, 0) AS n_items, least(CASE WHEN n > 0 THEN 40 ELSE 0 END + CASE WHEN n > 1 THEN 20 ELSE 0 END + CASE WHEN n > 3 THEN 10 ELSE 0 END + CASE WHEN total_cost::DOUBLE BETWEEN 0.01 AND 1000000 THEN 20 ELSE 0 END
 + CASE WHEN abs(coalesce(cost, 0) - coalesce(total_cost::DOUBLE, 0)) <= 1.0 THEN 30 ELSE 0 END + least(coalesce(described, 0), 20), 100)::INTEGER AS confidence FROM quote_summary LEFT JOIN g USING (doc_id)""",
)
def _(s, d):
    return scoring.confidence(typed_items(s, d), table(s, d, "quote_summary").select("doc_id", F.col("total_cost").cast("double").alias("stated_cost")))


@query(
    "item_confidence",
    f"""WITH {money_sql.TYPED} SELECT item_id, (CASE WHEN quantity IS NULL OR unit_price IS NULL OR cost IS NULL THEN 30 ELSE least(50 + CASE WHEN abs(quantity * unit_price - cost) <= 0.0100001 THEN 30 ELSE 0 END + CASE WHEN unit_price BETWEEN 0.01 AND 100000 AND quantity BETWEEN 0.1 AND 10000 THEN 20 ELSE 0 END
 + CASE WHEN length(description) > 5 AND regexp_matches(description, '\\pL') THEN 20 ELSE 0 END, 100) END)::INTEGER AS confidence FROM i""",
)
def _(s, d):
    return typed_items(s, d).select("item_id", scoring.item_confidence(*(F.col(c) for c in ("description", "quantity", "unit_price", "cost"))).alias("confidence"))


@query(
    "recomputed_prices",
    f"""WITH {money_sql.TYPED} SELECT item_id, CASE WHEN quantity > 0 AND cost > 0 AND (unit_price IS NULL OR unit_price = 0 OR abs(unit_price - cost / quantity) > 0.01) THEN round_even(cost / quantity, 2) ELSE unit_price END AS unit_price FROM i""",
)
def _(s, d):
    return typed_items(s, d).select("item_id", scoring.recomputed_price(F.col("quantity"), F.col("unit_price"), F.col("cost")).alias("unit_price"))


@query(
    "totals_with_copies",
    f"""WITH {money_sql.TYPED}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(description, ' ')), unit_price ORDER BY line_no, item_id) AS n FROM i)
 SELECT doc_id, count(*) AS n_items, round(sum(cost), 2) AS total_cost, count(*) FILTER (n = 1) AS n_kept, round(sum(cost) FILTER (n = 1), 2) AS kept_cost FROM k GROUP BY 1""",
)
def _(s, d):
    t = typed_items(s, d)
    every = t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("cost"), 2).alias("total_cost"))
    kept = grouping.without_exact_copies(t, ["line_no", "item_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.sum("cost"), 2).alias("kept_cost"))
    return every.join(kept, "doc_id")


@query(
    "term_weights",
    """WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(description), '[\\pL\\pN]{2,}')) AS term FROM quote_items), f AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
 SELECT item_id, term, tf, round(ln(((SELECT count(*) FROM quote_items WHERE description IS NOT NULL) + 1) / (df + 1)) + 1, 6) AS idf FROM f JOIN d USING (term)""",
)
def _(s, d):
    return scoring.term_weights(table(s, d, "quote_items").select("item_id", "description"))


@query("live_items")
def _(s, d):
    return parsing.live_items(docs(s, d))


@query("template_results")
def _(s, d):
    return parsing.as_results(parsing.parse_quotes(docs(s, d)), adjustments.extract(doc_lines(s, d)))


@query("normalized_items", None)
def _(s, d):
    return parsing.parse_quotes(docs(s, d)).select("doc_id", "line_no", lines.clean_description(descriptions.expand(F.col("description"))).alias("description"), "quantity", "unit_price", "cost")


# queries of plans.quotes whose SQL needs the places of tokens

ORACLE["number_places"] = f"""WITH {LINES}, k AS ({placed(f'({P.NUMBER})', 'doc_id, line_no, line', 'l')}) SELECT doc_id, line_no, place, start, raw, substr(line, start, 1) IN ('$', '€') AND start > 0 AS is_money, regexp_matches({near('start', 'length(raw)', 10)}, 'qty|quantity|pcs|each|ea') AS is_quantity FROM k"""

QUANTITY = [r"(?i)(?:qty|quantity|amount|count):\s*(\d+)", r"(?i)(?:qty|quantity|amount|count)\s+(\d+)", r"(?i)(\d+)\s*(?:pieces?|units?|ea|each|pcs)", r"^(\d+)\s+", r"(\d+)\s*[×x]", r"(\d+)\s*@", r"(\d+)\s*\$"]
_first = ", ".join(f"CASE WHEN try_cast(nullif(regexp_extract(line, {literal(p)}, 1), '') AS BIGINT) BETWEEN 1 AND 10000 THEN regexp_extract(line, {literal(p)}, 1)::BIGINT END" for p in QUANTITY)
ORACLE["flexible_quantity"] = f"""WITH {LINES} SELECT doc_id, line_no, coalesce({_first}, list_filter(list_transform(list_filter(regexp_extract_all(line, '[\\pL\\pN_]+'), lambda w: regexp_full_match(w, '\\d+')), lambda w: try_cast(w AS BIGINT)), lambda v: v BETWEEN 1 AND 1000)[1], 1)::INTEGER AS quantity FROM l"""

_FIXED = f"array_to_string(list_transform({WORDS.format('b')}, lambda w: CASE WHEN regexp_full_match(w, '[$0-9.,\\-OlI§S]+') THEN translate(w, 'OlIS§', '01155') ELSE w END), ' ')"
ORACLE["preprocessed_lines"] = f"""WITH {TRIMMED}, w AS (SELECT *, {WORDS.format('line')} AS w FROM t WHERE line <> ''), k AS (SELECT doc_id, line_no, line FROM w WHERE NOT (len(w) > 0 AND 2 * len(list_filter(w, lambda x: contains(x, 'cid:'))) > len(w))),
 c AS (SELECT doc_id, line_no, CASE WHEN contains(line, 'cid:') THEN trim(regexp_replace(regexp_replace(line, '\\bcid:\\d+\\s*', ' ', 'g'), '\\s+', ' ', 'g'), ' ') ELSE line END AS b0, contains(line, 'cid:') AS had FROM k), e AS (SELECT doc_id, line_no, CASE WHEN had AND regexp_full_match(b0, '[:\\s.,\\-]+') THEN '' ELSE b0 END AS b FROM c),
 f AS (SELECT doc_id, line_no, {_FIXED} AS line FROM e), n AS (SELECT *, regexp_extract_all(line, '[\\d,]+\\.?\\d*') AS x FROM f), p AS (SELECT *, instr(line, x[1]) AS pos FROM n)
 SELECT doc_id, line_no, CASE WHEN len(x) = 2 AND contains(line, '$') AND try_cast(replace(x[1], ',', '') AS DOUBLE) = try_cast(replace(x[2], ',', '') AS DOUBLE) AND pos > 1 AND substr(line, pos - 1, 1) IN (' ', '-') THEN substr(line, 1, pos - 1) || '1 ' || substr(line, pos) ELSE line END AS line FROM p"""

ORACLE["column_detection"] = f"""WITH {LINES}, k AS ({placed('([ \\t\\n\\v\\f\\r]{2,})'.replace(chr(92) * 2, chr(92)), 'doc_id, line_no, line', 'l')}), c AS (SELECT doc_id, start AS position, count(*) AS n_lines, min(line_no) AS seen FROM k GROUP BY 1, 2),
 r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n_lines DESC, seen, position))::INTEGER AS place FROM c) SELECT doc_id, position, n_lines, place FROM r WHERE place <= 5 AND n_lines >= 3"""

_CENTS = "list_transform(x, lambda y: CASE WHEN regexp_matches(y, '[.,]\\d{2}$') THEN regexp_replace(y, '[.,]', '', 'g') ELSE regexp_replace(y, '[.,]', '', 'g') || '00' END::DOUBLE)"
_ORDERS = [("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")]
_FIT = " ".join(f"WHEN {q} BETWEEN 10 AND 1000000 AND {p} > 0 AND {z} > 0 AND 90 * {z} <= {q} * {p} AND {q} * {p} <= 110 * {z} THEN [{q}, {p}, {z}]" for q, p, z in _ORDERS)
ORACLE["permutation_match"] = f"""WITH {LINES}, x AS (SELECT doc_id, line_no, regexp_extract_all(line, {literal(P.TOKEN)}) AS x FROM l), v AS (SELECT doc_id, line_no, {_CENTS} AS v FROM x WHERE len(x) >= 3),
 i AS (SELECT *, unnest(range(1, len(v) - 1)) AS i FROM v), j AS (SELECT *, unnest(range(i + 1, len(v))) AS j FROM i), k AS (SELECT doc_id, line_no, i, j, k, v[i] AS a, v[j] AS b, v[k] AS c FROM (SELECT *, unnest(range(j + 1, len(v) + 1)) AS k FROM j)),
 h AS (SELECT doc_id, line_no, CASE {_FIT} END AS hit, i, j, k FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i, j, k) AS n FROM h WHERE hit IS NOT NULL)
 SELECT doc_id, line_no, hit[1] / 100 AS quantity, hit[2] / 100 AS unit_price, hit[3] / 100 AS cost FROM f WHERE n = 1"""

ORACLE["unread_amounts"] = f"""WITH {money_sql.ITEMS}, q AS (SELECT item_id, doc_id, quantity, unit_price, cost, price_usd, total_usd, CASE WHEN n >= 0 AND n < 1e9 AND n = floor(n) THEN n END AS n FROM quote_items JOIN usd USING (item_id, doc_id))
 SELECT item_id, doc_id, 'quantity' AS field, quantity AS text FROM q WHERE trim(quantity, ' ') <> '' AND n IS NULL UNION ALL SELECT item_id, doc_id, 'unit_price', unit_price FROM q WHERE trim(unit_price, ' ') <> '' AND price_usd IS NULL UNION ALL SELECT item_id, doc_id, 'cost', cost FROM q WHERE trim(cost, ' ') <> '' AND total_usd IS NULL"""

ORACLE["template_results"] = f"""WITH {_adjustment_sql()}, t AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM l), {PARSED}, g AS (SELECT doc_id, sum(quantity)::BIGINT AS quantity, round(sum(unit_price), 2) AS unit_price, round(sum(cost), 2) AS total_price, count(*) AS n FROM items GROUP BY 1),
 z AS (SELECT doc_id, arg_max(value, line_no) AS total FROM a WHERE kind = 'total' GROUP BY 1)
 SELECT doc_id, coalesce(quantity, 1) AS quantity, coalesce(unit_price, total) AS unit_price, coalesce(total_price, total) AS total_price, coalesce(n, 1) AS n_items, coalesce(total, total) AS total, n IS NULL AS default_item FROM g FULL JOIN z USING (doc_id)"""
