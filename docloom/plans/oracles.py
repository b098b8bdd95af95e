"""For each query that SQL can express, SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from docloom.functions import predicates as P
from docloom.functions.identifiers import PERMUTED, PRODUCT
from docloom.functions.predicates import KEYWORD_LOOKALIKES
from docloom.functions.text import QUALITY_LABELS
from docloom.operators.classify import SHAPES, SIGNALS

B36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS, LETTERS = "0123456789", "BCDFGHJKLM"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def letters(key: str, width: int = 4) -> str:
    return f"translate(lpad(CAST({key} AS VARCHAR), {width}, '0'), '{DIGITS}', '{LETTERS}')"


def gstin(key: str) -> str:
    body = f"(lpad(CAST({key} % 37 + 1 AS VARCHAR), 2, '0') || 'ZZZZZ' || lpad(CAST({key} % 10000 AS VARCHAR), 4, '0') || 'Z1Z')"
    product = f"((instr('{B36}', substr({body}, CAST(i AS INT), 1)) - 1) * (2 - i % 2))"
    total = f"list_sum([{product} // 36 + {product} % 36 for i in range(1, 15)])"
    return f"({body} || substr('{B36}', CAST((36 - {total} % 36) % 36 + 1 AS INT), 1))"


ITEMS = """
items AS (
  SELECT l_orderkey AS k, l_linenumber AS ln, l_suppkey AS s, p_name AS name, CAST(p_partkey % 9000 + 1000 AS VARCHAR) AS hsn,
         CAST(l_quantity AS BIGINT) + 1 AS q, CAST(round(p_retailprice * 100) AS BIGINT) AS price
  FROM (SELECT * FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)
  JOIN part ON l_partkey = p_partkey),
sums AS (SELECT k, sum(q * price) AS sub, min(s) AS s, count(*) AS n FROM items GROUP BY k),
inv AS (
  SELECT o_orderkey AS k, o_custkey AS c, s, n, o_orderdate AS d, CAST(sub AS BIGINT) AS sub, CAST((sub * 9 + 50) // 100 AS BIGINT) AS half
  FROM orders JOIN sums ON o_orderkey = k)
"""

INVOICE = f"""
WITH {ITEMS}
SELECT k AS doc_id, 'INV' || lpad(CAST(k AS VARCHAR), 7, '0') AS invoice_number,
       strftime(d + INTERVAL 10 YEAR, '%Y-%m-%d') AS invoice_date, 'VENDOR ' || {letters('s')} || ' INDUSTRIES LIMITED' AS vendor_name,
       {gstin('s')} AS vendor_gstin, 'CLIENT ' || {letters('c', 6)} || ' RETAIL SOLUTIONS LLP' AS buyer_name,
       {gstin('(c + 5000)')} AS buyer_gstin, sub AS subtotal_cents, 2 * half AS tax_cents, sub + 2 * half AS total_cents,
       n AS n_items, sub AS items_total_cents, (sub + 2 * half) // 100 AS words_total, 'SUCCESS' AS status
FROM inv
"""

LINE_ITEMS = f"""
WITH {ITEMS}
SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY ln) AS INTEGER) AS item_no, name AS description, hsn,
       q AS quantity, price AS price_cents, q * price AS amount_cents
FROM items SEMI JOIN orders ON k = o_orderkey
"""

SCORES = f"WITH {ITEMS} SELECT k AS doc_id, 125 * n AS score, sub AS items_cents FROM inv"

RECONSTRUCTION = """
SELECT o_orderkey AS doc_id, net AS subtotal, net * 18 // 100 AS tax
FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) + 2000 AS net FROM orders)
"""

CERTIFICATES = f"""
SELECT c_custkey AS doc_id, 'CITY ' || {letters('c_custkey')} || ' HOSPITAL' AS organization_name,
       'Ravi Na' || lower({letters('c_custkey')}) AS applicant_name,
       strftime(DATE '2024-01-01' + CAST(c_custkey % 300 AS INT), '%d-%m-%Y') AS from_date,
       strftime(DATE '2024-01-01' + CAST(c_custkey % 300 + c_custkey % 20 AS INT), '%d-%m-%Y') AS to_date,
       CAST(c_custkey % 20 + 1 AS VARCHAR) AS total_absent_days
FROM customer
"""


def check_digit(source: str, key: str) -> str:
    """A FROM item with columns of source and `number`: eleven digits of a key with their Verhoeff digit."""
    product, permuted = (f"[{', '.join(map(str, t))}]" for t in (PRODUCT, PERMUTED))
    out = f"(SELECT *, '2' || lpad(CAST({key} AS VARCHAR), 10, '0') AS b, 0 AS c0 FROM {source})"
    for i in range(11):
        digit = f"CAST(substr(b, {11 - i}, 1) AS INT)"
        out = f"(SELECT *, {product}[c{i} * 10 + {permuted}[{(i + 1) % 8 * 10} + {digit} + 1] + 1] AS c{i + 1} FROM {out})"
    inverse = [next(b for b in range(10) if PRODUCT[a * 10 + b] == 0) for a in range(10)]
    return f"(SELECT *, b || CAST({inverse}[c11 + 1] AS VARCHAR) AS number FROM {out})"


CARD_NAME = f"'RAVI ' || translate({letters('k', 6)}, 'BCDFGHJ', 'AEIOURN') || ' DEVA'"
ID_CARDS = f"""
SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN 'AADHAAR' WHEN 1 THEN 'PAN' ELSE 'DRIVING_LICENSE' END AS document_type, {CARD_NAME} AS name,
       strftime(DATE '1970-01-01' + CAST(k % 9000 AS INT), '%d/%m/%Y') AS dob, CASE WHEN k % 3 = 0 THEN 'MALE' END AS gender,
       CASE WHEN k % 3 = 0 THEN substr(number, 1, 4) || ' ' || substr(number, 5, 4) || ' ' || substr(number, 9, 4) END AS aadhaar_number,
       CASE WHEN k % 3 = 1 THEN 'ABCPZ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || 'Q' END AS pan_number,
       CASE WHEN k % 3 = 1 THEN 'MOHAN ARAV DEVA' END AS father_name,
       CASE WHEN k % 3 = 2 THEN 'TS' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '2015' || lpad(CAST(k AS VARCHAR), 7, '0') END AS dl_number,
       CASE WHEN k % 3 = 2 THEN '01/02/2015' END AS valid_from, CASE WHEN k % 3 = 2 THEN '31/01/2035' END AS valid_to, 'HIGH' AS confidence
FROM (SELECT c_custkey AS k, number FROM {check_digit('customer', 'c_custkey')})
"""

TEMPLATES = f"WITH {ITEMS} SELECT k AS doc_id, 'VENDOR ' || {letters('s')} || ' INDUSTRIES LIMITED' AS vendor_name FROM inv"

LINE_INDEX = r"""
WITH p AS (
  SELECT doc_id, unnest(string_split(t, chr(12))) AS page, unnest(range(1, len(string_split(t, chr(12))) + 1)) AS pn
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)),
r AS (SELECT doc_id, pn, unnest(string_split(replace(page, chr(9), ' '), chr(10))) AS line FROM p),
b AS (
  SELECT doc_id, pn, [regexp_replace(x, '\s+', ' ', 'g') for x in regexp_split_to_array(line, '\s{3,}') if x <> ''] AS bs
  FROM r WHERE regexp_matches(line, '\S')),
e AS (SELECT doc_id, pn, len(bs) AS n, unnest(bs) AS x, unnest(range(len(bs))) AS i FROM b)
SELECT doc_id, count(*) AS n_lines, max(pn) AS n_pages, count(*) FILTER (n > 1 AND i = 0) AS n_left,
       count(*) FILTER (i > 0) AS n_right, CAST(sum(length(trim(x))) AS BIGINT) AS n_chars
FROM e GROUP BY doc_id
"""

CLEANING = r"""
SELECT doc_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS line, md5(upper(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'))) AS key,
       md5(regexp_replace(t, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS edges,
       md5(translate(upper(p), 'OQDILZSBG', '000112586')) AS digits, md5(translate(upper(p), '012568', 'OIZSGB')) AS letters
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(text, '[^ -~]', '', 'g') AS p FROM documents)
"""

LINES = "l AS (SELECT doc_id, trim(x) AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) WHERE trim(x) <> '')"


def contains_any(words: tuple[str, ...]) -> str:
    table = str.maketrans(*KEYWORD_LOOKALIKES)
    out = []
    for word in dict.fromkeys(w.lower() for w in words):
        bare = "".join(x for x in word if x.isascii() and x.isalnum())
        out += [f"contains(lo, {quoted(word)})", f"contains(co, {quoted(bare)})", f"contains(fo, {quoted(bare.translate(table))})"]
    return f"count(*) FILTER ({' OR '.join(out)})"


KEYWORDS = rf"""
WITH {LINES}, c AS (
  SELECT doc_id, lower(t) AS lo, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS co,
         translate(regexp_replace(regexp_replace(lower(t), '\b[0-9][0-9.,]*\b', ' ', 'g'), '[^a-z0-9]', '', 'g'), '{KEYWORD_LOOKALIKES[0]}', '{KEYWORD_LOOKALIKES[1]}') AS fo
  FROM l)
SELECT doc_id, {contains_any(P.BUSINESS)} AS business, {contains_any(P.GOVERNMENT)} AS government, {contains_any(P.BANK)} AS bank,
       {contains_any(P.ITEM_STOP)} AS item_stop
FROM c GROUP BY doc_id
"""


def score(kind: str) -> str:
    terms = [f"CASE WHEN contains(t, {quoted(w)}) THEN {3 if len(w) > 10 else 1} ELSE 0 END" for w in SIGNALS[kind]]
    terms += [f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN 5 ELSE 0 END" for p in SHAPES[kind]]
    return " + ".join(terms)


CARD_TEXTS = f"""
cards AS (
  SELECT k, CASE k % 3
    WHEN 0 THEN concat_ws(chr(10), 'GOVERNMENT OF INDIA', {CARD_NAME}, 'DOB: ' || born, 'MALE',
      substr(number, 1, 4) || ' ' || substr(number, 5, 4) || ' ' || substr(number, 9, 4), 'ADDRESS: S/O SOMEBODY', '12-3 TEST ROAD 500001')
    WHEN 1 THEN concat_ws(chr(10), 'INCOME TAX DEPARTMENT', 'GOVT OF INDIA', {CARD_NAME}, 'MOHAN ARAV DEVA', born, 'PERMANENT ACCOUNT NUMBER',
      'ABCPZ' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || 'Q')
    ELSE concat_ws(chr(10), 'DRIVING LICENCE', 'DL NO TS' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '2015' || lpad(CAST(k AS VARCHAR), 7, '0'),
      'NAME: ' || {CARD_NAME}, 'DOB: ' || born, 'VALID FROM: 01/02/2015', 'VALID TO: 31/01/2035') END AS text
  FROM (SELECT c_custkey AS k, number, strftime(DATE '1970-01-01' + CAST(c_custkey % 9000 AS INT), '%d/%m/%Y') AS born
        FROM {check_digit('customer', 'c_custkey')}))
"""

CLASSIFICATION = f"""
WITH {CARD_TEXTS}, d AS (SELECT doc_id, upper(coalesce(text, '')) AS t FROM documents UNION ALL SELECT -1 - k, text FROM cards),
s AS (SELECT doc_id, {score('AADHAAR')} AS a, {score('PAN')} AS p, {score('DRIVING_LICENSE')} AS l FROM d)
SELECT doc_id, CASE WHEN greatest(a, p, l) = 0 THEN 'UNKNOWN' WHEN a = greatest(a, p, l) THEN 'AADHAAR' WHEN p = greatest(a, p, l) THEN 'PAN'
       ELSE 'DRIVING_LICENSE' END AS document_type, a AS score_aadhaar, p AS score_pan, l AS score_driving_license
FROM s
"""

NUMBERED = "n AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no FROM (SELECT doc_id, trim(x) AS t, i FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents) WHERE trim(x) <> ''))"

QUALITY = rf"""
WITH {NUMBERED}, w AS (
  SELECT doc_id, line_no, t, len(ws) AS words, len([x for x in ws if length(x) < 3]) AS short
  FROM (SELECT *, [x for x in regexp_split_to_array(t, '\s+') if x <> ''] AS ws FROM n)),
q AS (
  SELECT doc_id, line_no, CAST(length(t) - 4 * (length(t) - length(replace(t, '?', ''))) - 2 * (length(t) - length(replace(t, chr(39), ''))) - 10 * short
    + CASE WHEN regexp_matches(t, '\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b') THEN 35 ELSE 0 END
    + CASE WHEN regexp_matches(t, '\d{{2}}/\d{{2}}/\d{{4}}') THEN 25 ELSE 0 END
    + CASE WHEN regexp_matches(t, '\b[2-9]\d{{3}}\s\d{{4}}\s\d{{4}}\b') THEN 20 ELSE 0 END
    + CASE WHEN {' OR '.join(f"contains(t, {quoted(x)})" for x in QUALITY_LABELS)} THEN 12 ELSE 0 END
    + CASE WHEN regexp_matches(t, '^[A-Z]{{3,}}(?:\s[A-Z]{{3,}}){{1,4}}$') THEN 16 ELSE 0 END
    - CASE WHEN words >= 4 AND short >= words - 1 THEN 30 ELSE 0 END AS INTEGER) AS quality
  FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, line_no) AS INTEGER) AS rank, CAST(line_no AS INTEGER) AS line_no, quality
FROM q QUALIFY rank <= 3
"""

LONGEST = f"""
WITH {NUMBERED}
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(t) AS INTEGER) AS n FROM n
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(t) DESC, line_no) = 1
"""

PASSES = "SELECT c_custkey AS doc_id, 1 AS page_no, 'CUSTOMER RECORD' || chr(10) || 'ACCOUNT ' || CAST(c_custkey AS VARCHAR) AS text FROM customer"

VERHOEFF = f"""
SELECT c_custkey, number, true AS valid, false AS wrong_valid, substr(number, 1, 4) || ' ' || substr(number, 5, 4) || ' ' || substr(number, 9, 4) AS grouped
FROM {check_digit('customer', 'c_custkey')}
"""

GSTIN = f"""
WITH g AS (SELECT s_suppkey, {gstin('s_suppkey')} AS gstin FROM supplier),
d AS (SELECT *, translate(substr(gstin, 1, 2), '012568', 'OIZSGB') || substr(gstin, 3, 5) || translate(substr(gstin, 8, 4), '012568', 'OIZSGB')
             || substr(gstin, 12, 4) AS damaged FROM g)
SELECT s_suppkey, gstin, true AS valid, true AS checks,
       CASE WHEN damaged <> gstin THEN substr(gstin, 1, 14) || translate(substr(gstin, 15, 1), 'OQDILR', '000112') ELSE gstin END AS repaired,
       substr(gstin, 3, 10) AS pan, substr(gstin, 1, 2) AS state
FROM d
"""

IDENTIFIERS = """
SELECT c_custkey, 'ABCOZ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'G' AS pan,
       'TS' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '2015' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') AS licence,
       'ABCD0' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS ifsc, '1' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS invoice
FROM customer
"""

DISTANCES = """
SELECT p_partkey, CAST(levenshtein(p_name, lower(p_type)) AS INTEGER) AS levenshtein,
       CAST(len([1 for i in range(1, least(length(p_name), length(p_type)) + 1) if substr(p_name, CAST(i AS INT), 1) <> substr(lower(p_type), CAST(i AS INT), 1)])
            + abs(length(p_name) - length(p_type)) AS INTEGER) AS places
FROM part
"""

AMOUNTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cents,
       CASE WHEN cents % 100 = 0 THEN CAST(cents // 100 AS VARCHAR) WHEN cents % 10 = 0 THEN CAST(cents // 100 AS VARCHAR) || '.' || CAST(cents % 100 // 10 AS VARCHAR)
            ELSE CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS text
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
"""

WORDS = "SELECT o_orderkey, CAST(floor(o_totalprice * 37) AS BIGINT) AS n FROM orders"

DATES = """
WITH d AS (
  SELECT o_orderkey, o_orderkey % 7 AS way, CAST(o_orderdate AS DATE) AS d,
         CASE WHEN o_orderkey % 7 = 6 THEN make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS day
  FROM orders)
SELECT o_orderkey, day, year(day) >= 2000 AND day <= DATE '2025-04-01' AS valid,
       way = 5 OR month(d) IN (1, 3, 5, 7, 8, 10, 12) AS has_31, CASE WHEN way < 4 THEN d END AS medical
FROM d
"""

FULL_DATE = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.]((?:19|20)\d{2})\b"
NORMAL_DATE = rf"""CASE WHEN regexp_matches(x, '{FULL_DATE}') THEN lpad(regexp_extract(x, '{FULL_DATE}', 1), 2, '0') || '/'
  || lpad(regexp_extract(x, '{FULL_DATE}', 2), 2, '0') || '/' || regexp_extract(x, '{FULL_DATE}', 3) ELSE trim(x) END"""
DATE_SCAN = rf"""
WITH {CARD_TEXTS}, d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT -1 - k, text FROM cards),
f AS (
  SELECT doc_id,
    flatten([regexp_extract_all(t, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b'), regexp_extract_all(t, '\b\d{{1,2}}-\d{{1,2}}-\d{{2,4}}\b'),
      regexp_extract_all(t, '\b\d{{1,2}}\.\d{{1,2}}\.\d{{2,4}}\b'), regexp_extract_all(t, '\b\d{{1,2}}\.[A-Za-z]{{3,9}}\.\d{{2,4}}\b'),
      regexp_extract_all(t, '\b\d{{1,2}}-[A-Za-z]{{3,9}}-\d{{2,4}}\b'), regexp_extract_all(t, '\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b')]) AS a,
    list_concat(regexp_extract_all(upper(t), '{FULL_DATE}'),
      regexp_extract_all(upper(t), '\b[0-9OQDILSZBG]{{1,2}}[/\-.][0-9OQDILSZBG]{{1,2}}[/\-.][0-9OQDILSZBG]{{4}}\b')) AS raw
  FROM d),
n AS (SELECT doc_id, a, [{NORMAL_DATE} for x in [translate(y, 'OQDILZSBG', '000112586') for y in raw]] AS b FROM f)
SELECT doc_id, array_to_string(a, ',') AS invoice, array_to_string([b[i] for i in range(1, len(b) + 1) if list_position(b, b[i]) = i], ',') AS id
FROM n WHERE len(a) > 0 OR len(b) > 0
"""

#: Numbers of six digits, and of 9 to 18, are whole runs of digits.
ENTITIES = rf"""
WITH {LINES}, r AS (SELECT doc_id, t, regexp_extract_all(t, '[0-9]+') AS runs, regexp_matches(lower(t), 'a/c|account|acc') AS about FROM l)
SELECT * FROM (
  SELECT doc_id, CAST(sum(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}'))) AS BIGINT) AS mails,
         CAST(sum(len(regexp_extract_all(t, '\b[A-Z]{{4}}0[A-Z0-9]{{6}}\b'))) AS BIGINT) AS codes,
         CAST(sum(len(regexp_extract_all(t, '\b[A-Z]{{2}}[ -]?\d{{1,2}}[ -]?[A-Z]{{1,3}}[ -]?\d{{4}}\b'))) AS BIGINT) AS vehicles,
         CAST(sum(len([x for x in runs if length(x) = 6 AND x[1] <> '0'])) AS BIGINT) AS pincodes,
         CAST(sum(CASE WHEN about THEN len([x for x in runs if length(x) BETWEEN 9 AND 18]) ELSE 0 END) AS BIGINT) AS accounts
  FROM r GROUP BY doc_id)
WHERE mails + codes + vehicles + pincodes + accounts > 0
"""

TAX = """
WITH x AS (SELECT l_linenumber, l_extendedprice AS s, round(l_extendedprice * l_tax, 2) AS t FROM lineitem),
y AS (SELECT *, s + t + l_linenumber * 300 AS total FROM x)
SELECT l_linenumber, count(*) FILTER (abs(s + t - total) <= greatest(1.0, greatest(abs(s + t), abs(total)) * 0.02)) AS agree,
       count(*) FILTER (s > 0 AND (abs(t / s - 0.05) <= 0.025 OR abs(t / s - 0.12) <= 0.025 OR abs(t / s - 0.18) <= 0.025 OR abs(t / s - 0.28) <= 0.025)) AS usual
FROM y GROUP BY l_linenumber
"""

EVENTS = "SELECT date_trunc('hour', ts) AS window_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"


SEARCH = f"SELECT s_suppkey, {gstin('s_suppkey')} AS found FROM supplier"


def oracle_sql() -> dict[str, str]:
    from docloom.plans import damaged

    return damaged.oracle_sql() | {
        "gstin_search": SEARCH,
        "invoice_round_trip": INVOICE, "line_item_round_trip": LINE_ITEMS, "line_item_scores": SCORES, "amount_reconstruction": RECONSTRUCTION,
        "certificate_round_trip": CERTIFICATES, "id_card_round_trip": ID_CARDS, "template_round_trip": TEMPLATES, "line_index": LINE_INDEX,
        "text_cleaning": CLEANING, "keyword_lines": KEYWORDS, "classification": CLASSIFICATION, "line_quality_top": QUALITY,
        "longest_line": LONGEST, "pass_merge": PASSES, "verhoeff_numbers": VERHOEFF, "gstin_numbers": GSTIN, "identifier_repair": IDENTIFIERS,
        "distances": DISTANCES, "amount_parsing": AMOUNTS, "amount_words": WORDS, "date_parsing": DATES, "date_scan": DATE_SCAN,
        "entity_scan": ENTITIES, "tax_checks": TAX, "event_windows": EVENTS,
    }
