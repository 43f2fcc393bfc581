"""Amounts in US dollars stated in SQL of another engine, for the forms of writing that the tables hold."""

from __future__ import annotations

FIGURE = "-?[0-9](?:[0-9.,'']|[\u00a0\u202f][0-9])*"
LATIN = ("АВЕКМНОРСТУХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο０１２３４５６７８９\u00a0\u2002\u2007\u2009\u202f\u3000", "ABEKMHOPCTYXaeopcyxijsABEZHIKMNOPTYXo0123456789      ")
HIDDEN = "[\u00ad\u200b\u200c\u200d\u2060\ufeff]"
WORDS = {
    100: "100|hundred|hundert|cento|cent|ciento|cien|C",
    12: "12|dozen|doz|dz|dutzend|douzaine|docena|dúzia",
    1000: "1000|1 ?k|thousand|tausend|mille|millar|mil|milhar|M",
    2: "2|pairs?|paar|paire|par",
}


def number(text: str) -> str:
    """The number of the first figure of a text, by the feed's decimal mark."""
    raw = f"regexp_replace(regexp_replace(regexp_extract({text}, '{FIGURE}'), '[.,'']+$', ''), '[''\u00a0\u202f]', '', 'g')"
    return f"""(SELECT try_cast(CASE WHEN d THEN CASE WHEN p THEN replace(r, ',', '') ELSE replace(replace(r, '.', ''), ',', '.') END ELSE regexp_replace(r, '[.,]', '', 'g') END AS DOUBLE) FROM
 (SELECT r, p, b OR (o AND ((CASE WHEN p THEN '.' ELSE ',' END) = coalesce(mark, '.') OR NOT regexp_matches(r, '[.,][0-9]{{3}}$'))) AS d FROM
 (SELECT r, b, o, CASE WHEN b THEN regexp_matches(r, '\\.[^.,]*$') ELSE contains(r, '.') END AS p FROM
 (SELECT r, contains(r, '.') AND contains(r, ',') AS b, length(regexp_replace(r, '[^.,]', '', 'g')) = 1 AS o FROM (SELECT {raw} AS r)))))"""


def unit(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '{FIGURE}', '#'), '[\\s\u00a0\u202f]*#[\\s\u00a0\u202f]*', '#'))"


def currency(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, '€|(?i:eur)') THEN 'EUR' WHEN regexp_matches({u}, '¢|^USc#|#(US cent|cents?|c|ct|cts|CTS)$') THEN 'USC' WHEN regexp_matches({u}, '[$]|USD|#K$') THEN 'USD' END"


def scale(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, '^k[$]#|[$]#k$|#K$|#T[$]$|#tsd[.] USD$|USD#thousand$|#kUSD$') THEN 1000.0 ELSE 1.0 END"


def basis(u: str) -> str:
    return f"""CASE WHEN regexp_matches({u}, '(/ ?100( pcs)?|/C|per C|per 100|p[.] hundred)$') THEN 100.0 WHEN regexp_matches({u}, '(/M|/1000 St[.]|/1k pcs|per thousand|per 1000)$') THEN 1000.0
 WHEN regexp_matches({u}, '(a dozen|per dozen|/dz|/doz)$') THEN 12.0 WHEN regexp_matches({u}, '(per pair|the pair|/pr)$') THEN 2.0 WHEN regexp_matches({u}, '(per pc|/ea|/pc|each)$') THEN 1.0 END"""


def said(description: str) -> str:
    clean = f"regexp_replace(translate({description}, '{LATIN[0]}', '{LATIN[1]}'), '{HIDDEN}', '', 'g')"
    before = "(?i)(?:(?:\\b(?:price|prices|priced|sold|preise?|prix|precio|preço|prezzo|cena|цена)\\b|[,(]|\\s-\\s)\\s*)(?:per|je|by the|au|à la|por|pro|par|za|за|la)\\s+"
    counts = " ".join(f"WHEN regexp_matches({clean}, '{before}(?:{w})\\b') THEN {n}.0" for n, w in WORDS.items())
    return f"CASE WHEN regexp_matches({clean}, '\\[PU [0-9]+') THEN regexp_extract({clean}, '\\[PU ([0-9]+)', 1)::DOUBLE {counts} END"


def close(divisor: str, times: str = "1.0") -> str:
    return f"(abs(whole / {divisor} - total * {times}) <= 0.006 * (t_factor * {times} + abs(n) * p_factor / {divisor}) + 0.0005 * abs(total * {times}))"


def in_dollars(table: str, key: str, rest: str, price: str, total: str, description: str = "NULL::VARCHAR", total_first: bool = False) -> str:
    """CTEs that end in usd(key, rest, n, price_usd, price_case, total_usd, total_case)."""
    factor = lambda x: f"CASE WHEN {x}_scale <> 1 AND {x}_currency IS NULL THEN {x}_scale ELSE {x}_scale * CASE coalesce({x}_currency, bare, 'USD') WHEN 'USD' THEN 1.0 WHEN 'USC' THEN 0.01 ELSE w.factor END END"
    thousand = f"known AND t_currency IS NULL AND t_scale = 1 AND t_factor = 1 AND stated IS NULL AND NOT {close('1.0')} AND guess = 1000 AND {close('1.0', '1000.0')}" if total_first else "FALSE"
    return f"""m0 AS (SELECT t.*, {price} AS price_text, {total} AS total_text, f.decimal_mark AS mark, f.amount_unit AS bare FROM {table} t LEFT JOIN quote_summary s USING (doc_id) LEFT JOIN feeds f USING (feed_id)),
 m1 AS (SELECT {key}, doc_id, {rest} bare, {number('quantity')} AS n, {number('price_text')} AS p, {number('total_text')} AS t, {unit('price_text')} AS pu, {unit('total_text')} AS tu, {said(description)} AS said FROM m0),
 m2 AS (SELECT *, {currency('pu')} AS p_currency, {scale('pu')} AS p_scale, {basis('pu')} AS stated, {currency('tu')} AS t_currency, {scale('tu')} AS t_scale FROM m1),
 m3 AS (SELECT m2.*, (SELECT {factor('p')} FROM (SELECT max(factor) AS factor FROM money_units WHERE unit_code = coalesce(p_currency, bare)) w) AS p_factor, (SELECT {factor('t')} FROM (SELECT max(factor) AS factor FROM money_units WHERE unit_code = coalesce(t_currency, bare)) w) AS t_factor FROM m2),
 m4 AS (SELECT *, n * p * p_factor / coalesce(stated, 1.0) AS whole, t * t_factor AS total FROM m3),
 m5 AS (SELECT *, coalesce(total <> 0 AND whole <> 0, FALSE) AS known, CASE {' '.join(f"WHEN {close(b)} THEN {b}" for b in ('2.0', '12.0', '100.0', '1000.0'))} END AS guess FROM m4),
 m6 AS (SELECT *, coalesce({thousand}, FALSE) AS thousand, CASE WHEN stated IS NULL THEN CASE WHEN known AND NOT {close('1.0')} THEN coalesce(guess, said) WHEN NOT known THEN said END END AS hidden0 FROM m5),
 m7 AS (SELECT *, CASE WHEN NOT thousand THEN hidden0 END AS hidden FROM m6),
 m8 AS (SELECT *, CASE WHEN known AND t_currency IS NULL AND t_scale = 1 AND t_factor = 1 AND hidden IS NULL AND NOT {close('1.0')} THEN CASE WHEN thousand THEN 1000.0 WHEN {close('1.0', '1.08')} THEN 1.08 WHEN {close('1.0', '0.01')} THEN 0.01 END END AS other FROM m7),
 usd AS (SELECT {key}, doc_id, {rest} n, round(p * p_factor / coalesce(stated, hidden, 1.0), 6) AS price_usd, p IS NOT NULL AND (p_factor <> 1 OR coalesce(stated, hidden, 1.0) <> 1) AS price_case, round(t * t_factor * coalesce(other, 1.0), 6) AS total_usd, t IS NOT NULL AND (t_factor <> 1 OR other IS NOT NULL) AS total_case FROM m8)"""


ITEMS = in_dollars("quote_items", "item_id", "line_no, description,", "unit_price", "cost", "description")
GROUPS = in_dollars("quote_groups", "group_id", "", "unit_price", "total_price", total_first=True)
#: quote_items with whole quantities, prices a piece and costs in US dollars.
TYPED = f"{ITEMS}, i AS (SELECT item_id, doc_id, line_no, description, CASE WHEN n >= 0 AND n < 1e9 AND n = floor(n) THEN n::INTEGER END AS quantity, price_usd AS unit_price, total_usd AS cost FROM usd)"
