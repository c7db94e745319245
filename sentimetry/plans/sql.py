"""DuckDB SQL fragments that rebuild the fixtures and operators independently
of the Spark code; the oracle side of every registered query."""

from __future__ import annotations

from ..sources import fixtures as fx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols: list[str]) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else repr(float(v)) if isinstance(v, float)
                                     else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


STOP_LIST = "(" + ", ".join(q(w) for w in fx.STOPWORDS) + ")"

CORPUS = """corpus AS (
  SELECT doc_id AS id,
         CAST(DATE '1995-01-01' + CAST((doc_id * 41) % 2405 AS INTEGER) AS DATE) AS date,
         text, lang, n_chars,
         CAST(regexp_extract(source, '^src(\\d+)$', 1) AS BIGINT) AS src
  FROM documents)"""

FEATS = """feats AS (
  SELECT id, 'press' AS feature, CAST(src % 3 = 0 AS DOUBLE) AS w FROM corpus
  UNION ALL SELECT id, 'web', CAST(src % 3 = 1 AS DOUBLE) FROM corpus
  UNION ALL SELECT id, 'news', CAST(id % 10 AS DOUBLE) / 9.0 FROM corpus
  UNION ALL SELECT id, 'products', CAST(lang = 'en' AS DOUBLE) FROM corpus
  UNION ALL SELECT id, 'results', CAST(n_chars > 2000 AS DOUBLE) FROM corpus
  UNION ALL SELECT id, 'other', 1.0 - CAST(src % 3 = 0 AS DOUBLE) FROM corpus)"""

CLEAN_EXPR = "lower(regexp_replace(text, '(^'')|(''s\\z)|[^\\p{L}+ \\t]', ' ', 'g'))"
SPLIT = "list_filter(string_split_regex({x}, '[ \\t+]+'), lambda t: t <> '')"

TOKS = f"""ctext AS (SELECT id, {CLEAN_EXPR} AS ct FROM corpus),
toks AS (SELECT id, ct, {SPLIT.format(x='ct')} AS tok FROM ctext),
words_all AS (SELECT id, unnest(tok) AS term, generate_subscripts(tok, 1) AS pos FROM toks),
words_prev AS (SELECT id, pos, term, lag(term) OVER (PARTITION BY id ORDER BY pos) AS prev FROM words_all)"""

LEXICON = "lex_raw AS (SELECT * FROM " + values(
    [(lx, x, y, i) for i, (lx, x, y) in enumerate(fx.LEXICON_ROWS)], ["lexicon", "x", "y", "pos"]) + ")"
VALENCE = "valence AS (SELECT * FROM " + values(fx.VALENCE_ROWS, ["x", "t", "y"]) + ")"
# O51 set-up in SQL: lower, first entry per (lexicon, word), shifters removed
LEX_SETUP = """lex AS (
  SELECT lexicon, x, y FROM (
    SELECT lexicon, lower(trim(x)) AS x, CAST(y AS DOUBLE) AS y,
           row_number() OVER (PARTITION BY lexicon, lower(trim(x)) ORDER BY pos) AS rn
    FROM lex_raw) WHERE rn = 1 AND x NOT IN (SELECT lower(x) FROM valence))"""
TIMELINE = "timeline AS (SELECT event, CAST(d AS DATE) AS date FROM " + values(
    fx.TIMELINE_ROWS, ["event", "d"]) + ")"
DICTIONARY = "dict AS (SELECT * FROM " + values(fx.DICTIONARY_ROWS, ["form", "lemma"]) + ")"
COEFS = "coefs AS (SELECT * FROM " + values(fx.COEF_ROWS, ["measure", "beta"]) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def units_sql(units=("word", "sentence"), valence: bool = True, stop: bool = True, ngram_lengths=()) -> str:
    """Units per document: words (with shifter factor), sentences, n-grams;
    plus ``wc`` per document (kept words + kept sentences)."""
    stop_cond = f"NOT IN {STOP_LIST}" if stop else "IS NOT NULL"
    parts, wc_parts = [], []
    if "word" in units:
        fac = "coalesce(v.y, 1.0)" if valence else "1.0"
        vj = "LEFT JOIN valence v ON v.x = w.prev" if valence else ""
        parts.append(f"""SELECT w.id, 'word' AS kind, w.term AS unit, {fac} AS factor
  FROM words_prev w {vj} WHERE w.term {stop_cond}""")
        wc_parts.append(f"SELECT id, count(*) AS n FROM words_prev WHERE term {stop_cond} GROUP BY id")
    if "sentence" in units:
        parts.append(f"""SELECT id, 'sentence' AS kind, unit, 1.0 AS factor FROM (
  SELECT id, unnest(list_transform(string_split_regex(ct, '[.!?]+\\s+'),
         lambda s: array_to_string({SPLIT.format(x='s')}, ' '))) AS unit FROM toks)
  WHERE unit <> '' AND unit {stop_cond}""")
        wc_parts.append(f"""SELECT id, count(*) AS n FROM (
  SELECT id, unnest(list_transform(string_split_regex(ct, '[.!?]+\\s+'),
         lambda s: array_to_string({SPLIT.format(x='s')}, ' '))) AS unit FROM toks)
  WHERE unit <> '' AND unit {stop_cond} GROUP BY id""")
    for n in ngram_lengths:
        leads = " || ' ' || ".join(["term"] + [f"lead(term, {k}) OVER (PARTITION BY id ORDER BY pos)"
                                              for k in range(1, n)])
        last = f"lead(term, {n - 1}) OVER (PARTITION BY id ORDER BY pos)"
        parts.append(f"""SELECT id, 'ngram' AS kind, unit, 1.0 AS factor FROM (
  SELECT id, {leads} AS unit, {last} AS lastw FROM words_all) WHERE lastw IS NOT NULL""")
    return ("units AS (\n" + "\nUNION ALL\n".join(parts) + "),\n"
            + "wc AS (SELECT c.id, CAST(coalesce(sum(n), 0) AS BIGINT) AS word_count FROM corpus c LEFT JOIN ("
            + " UNION ALL ".join(wc_parts) + ") u ON u.id = c.id GROUP BY c.id)")


def doc_scores_sql(how: str, **kw) -> str:
    """CTEs ending in ``doc_scores(id, date, word_count, lexicon, score)``."""
    hit = "units u JOIN lex l ON l.x = u.unit WHERE (u.kind <> 'ngram' OR contains(u.unit, ' '))"
    if how == "counts":
        agg = f"""raw AS (SELECT u.id, l.lexicon, sum(u.factor * l.y) AS s FROM {hit} GROUP BY 1, 2)"""
        scored = "coalesce(r.s, 0.0)"
    elif how == "proportional":
        agg = f"""raw AS (SELECT u.id, l.lexicon, sum(u.factor * l.y) AS s FROM {hit} GROUP BY 1, 2)"""
        scored = "CASE WHEN w.word_count = 0 THEN 0.0 ELSE coalesce(r.s, 0.0) / w.word_count END"
    else:
        agg = f"""ndocs AS (SELECT count(*) AS n FROM corpus),
dfreq AS (SELECT kind, unit, count(DISTINCT id) AS df FROM units GROUP BY 1, 2),
raw AS (SELECT u.id, l.lexicon, sum(u.factor * l.y * log10((SELECT n FROM ndocs) / d.df)) AS s
  FROM {hit.replace(' WHERE ', ' JOIN dfreq d ON d.kind = u.kind AND d.unit = u.unit WHERE ')} GROUP BY 1, 2)"""
        scored = "CASE WHEN w.word_count = 0 THEN 0.0 ELSE coalesce(r.s, 0.0) / w.word_count END"
    return (units_sql(**kw) + ",\n" + agg + f""",
lexnames AS (SELECT DISTINCT lexicon FROM lex),
doc_scores AS (
  SELECT c.id, c.date, w.word_count, n.lexicon, {scored} AS score
  FROM corpus c JOIN wc w ON w.id = c.id CROSS JOIN lexnames n
  LEFT JOIN raw r ON r.id = c.id AND r.lexicon = n.lexicon)""")


def doc_sentiment_sql(how: str, **kw) -> str:
    """… ending in ``doc_sent(id, date, word_count, lexicon, feature, score)``."""
    return doc_scores_sql(how, **kw) + """,
doc_sent AS (SELECT s.id, s.date, s.word_count, s.lexicon, f.feature, s.score * f.w AS score
  FROM doc_scores s JOIN feats f ON f.id = s.id)"""


def period_expr(col: str, by: str) -> str:
    return col if by == "day" else f"CAST(date_trunc('{by}', {col}) AS DATE)"


def period_index_expr(col: str, by: str) -> str:
    if by == "day":
        return f"(CAST({col} AS DATE) - DATE '1970-01-01')"
    if by == "month":
        return f"(year({col}) * 12 + month({col}) - 1)"
    if by == "week":
        return f"CAST(floor((CAST({col} AS DATE) - DATE '1970-01-05') / 7) AS INTEGER)"
    return f"year({col})"


def period_from_index_expr(col: str, by: str) -> str:
    if by == "day":
        return f"CAST(DATE '1970-01-01' + CAST({col} AS INTEGER) AS DATE)"
    if by == "month":
        return f"make_date(CAST(floor({col} / 12) AS INTEGER), CAST({col} % 12 + 1 AS INTEGER), 1)"
    if by == "week":
        return f"CAST(DATE '1970-01-05' + CAST({col} * 7 AS INTEGER) AS DATE)"
    return f"make_date(CAST({col} AS INTEGER), 1, 1)"


def agg_docs_sql(by: str, how_docs: str, ignore_zeros: bool, src: str = "doc_sent", name: str = "per_period") -> str:
    nz = "score <> 0" if ignore_zeros else "TRUE"
    if how_docs == "equal_weight":
        val = f"coalesce(sum(score) FILTER (WHERE {nz}) / nullif(count(*) FILTER (WHERE {nz}), 0), 0.0)"
    else:
        val = (f"coalesce(sum(score * word_count) / nullif(CAST(sum(word_count) FILTER (WHERE {nz}) AS DOUBLE), 0),"
               " 0.0)")
    return f"""{name} AS (SELECT {period_expr('date', by)} AS date, lexicon, feature, {val} AS value
  FROM {src} GROUP BY 1, 2, 3)"""


def fill_sql(by: str, fill: str, src: str = "per_period", name: str = "filled") -> str:
    if fill == "none":
        return f"{name} AS (SELECT * FROM {src})"
    idx = period_index_expr("date", by)
    val = "coalesce(p.value, 0.0)" if fill == "zero" else \
        "last_value(p.value IGNORE NULLS) OVER (PARTITION BY k.lexicon, k.feature ORDER BY g.i " \
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""bounds AS (SELECT min({idx}) AS lo, max({idx}) AS hi FROM {src}),
keys AS (SELECT DISTINCT lexicon, feature FROM {src}),
grid AS (SELECT unnest(range(lo, hi + 1)) AS i FROM bounds),
{name} AS (SELECT {period_from_index_expr('g.i', by)} AS date, k.lexicon, k.feature, {val} AS value
  FROM keys k CROSS JOIN grid g LEFT JOIN {src} p
  ON p.lexicon = k.lexicon AND p.feature = k.feature AND {period_index_expr('p.date', by)} = g.i)"""


def weights_sql(name: str, lag: int, most: int) -> str:
    """Unnormalised weights of a scheme, oldest first, from its formula;
    ``most``: greatest Almon order in use."""
    if name == "equal_weight":
        w = "1.0"
    elif name == "linear":
        w = "i"
    elif name.startswith("exponential"):
        alpha = name.removeprefix("exponential")
        w = f"{alpha} * pow(1 - {alpha}, {lag} - i)"
    else:
        order = name.removeprefix("almon").removesuffix("_inv")
        x = f"(1 - i / {lag}.0)" if name.endswith("_inv") else f"(i / {lag}.0)"
        w = f"(1 - pow(1 - {x}, {order})) * pow(1 - {x}, {most} - {order})"
    return f"list_transform(range(1, {lag + 1}), lambda i: CAST({w} AS DOUBLE))"


def roll_sql(schemes: dict, src: str = "filled", name: str = "rolled", keys=("lexicon", "feature")) -> str:
    lag = len(next(iter(schemes.values())))
    most = max([int(n.removeprefix("almon").removesuffix("_inv")) for n in schemes if n.startswith("almon")], default=0)
    k = ", ".join(keys)
    sel = " UNION ALL ".join(
        f"SELECT date, {k}, {q(n)} AS time, list_dot_product(v, {weights_sql(n, lag, most)}) / "
        f"list_sum({weights_sql(n, lag, most)}) AS value FROM framed" for n in schemes)
    return f"""framed0 AS (SELECT date, {k}, list(value) OVER (PARTITION BY {k} ORDER BY date
    ROWS BETWEEN {lag - 1} PRECEDING AND CURRENT ROW) AS v FROM {src}),
framed AS (SELECT * FROM framed0 WHERE len(v) = {lag}),
{name} AS ({sel})"""


def measures_sql(how_within, how_docs, by, lag, fill, ignore_zeros, schemes, units=("word", "sentence"),
                 valence=True, stop=True) -> str:
    """CTE chain ending in ``rolled(date, lexicon, feature, time, value)``."""
    pre = [CORPUS, FEATS, TOKS, LEXICON, VALENCE, LEX_SETUP]
    return with_(*pre) [:-1] + ",\n" + doc_sentiment_sql(how_within, units=units, valence=valence, stop=stop) + \
        ",\n" + agg_docs_sql(by, how_docs, ignore_zeros) + ",\n" + fill_sql(by, fill) + ",\n" + roll_sql(schemes) + "\n"
