"""The registered queries, each with DuckDB SQL that gives the same rows. Prefixes: txt_ text search, tree_ trees and
their encoding, tg_ tree patterns, gram_ grammars, frag_ fragments, eval_ evaluation, rank_ derivations, xf_ transforms, dop_ grammars of fragments,
head_ heads, dep_ dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.operators import dop, evaluate, fragments, grammar, heads, ranking, rewrite, textsearch, transforms, treequery
from dendrium.operators.staging import staged
from dendrium.sources import relations as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _docs(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), "doc_id", "text")


# --- text search ---

TH = r"\bth\w+"
_WORDS = r"len(regexp_extract_all(text, '\S+'))"


def _n(p: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, '(?m){p}'))"


@query("txt_report", rf"""
SELECT coalesce(source, 'TOTAL') AS corpus, n, words, round(1000 * n / words, 6) AS per_1000 FROM (
  SELECT source, sum({_n(TH)})::BIGINT AS n, sum({_WORDS})::BIGINT AS words FROM documents GROUP BY ROLLUP (source))""")
def txt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textsearch.report(_docs(spark, sf_dir), textsearch.compiled(TH))


@query("txt_counts", rf"SELECT source AS corpus, sum({_n(TH)})::BIGINT AS n FROM documents GROUP BY source")
def txt_counts(spark, sf_dir):
    return textsearch.counts(_docs(spark, sf_dir), textsearch.compiled(TH))


@query("txt_counts_ignore_case", r"SELECT source AS corpus, sum(len(regexp_extract_all(text, '(?mi)^the\b')))::BIGINT AS n FROM documents GROUP BY source")
def txt_counts_ignore_case(spark, sf_dir):
    return textsearch.counts(_docs(spark, sf_dir), textsearch.compiled(r"^the\b", ignore_case=True))


@query("txt_indices", rf"WITH {R.LINES_SQL} SELECT corpus, doc_id, lineno, {_n(TH, 'line')}::BIGINT AS n FROM lines WHERE {_n(TH, 'line')} > 0")
def txt_indices(spark, sf_dir):
    return textsearch.indices(R.document_lines(spark, sf_dir), textsearch.compiled(TH), ["corpus", "doc_id", "lineno"])


@query("txt_breakdown", rf"SELECT source AS corpus, match, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '(?m){TH}')) AS match FROM documents) GROUP BY ALL")
def txt_breakdown(spark, sf_dir):
    return textsearch.breakdown(_docs(spark, sf_dir), textsearch.compiled(TH))


BATCH = {"the": r"\bthe\b", "caps": r"\b[A-Z][a-z]+", "digits": r"[0-9]+", "nothing": r"zzzqqq"}


@query("txt_batch_counts", "SELECT source AS corpus, " + ", ".join(f"sum({_n(p)})::BIGINT AS \"{k}\"" for k, p in BATCH.items()) + " FROM documents GROUP BY source")
def txt_batch_counts(spark, sf_dir):
    return textsearch.batch_counts(_docs(spark, sf_dir), {k: textsearch.compiled(p) for k, p in BATCH.items()})


@query("txt_sentences", rf"""WITH {R.LINES_SQL}
SELECT corpus, doc_id, lineno, line, regexp_extract(line, '(?m){TH}') AS match, strpos(line, regexp_extract(line, '(?m){TH}x?')) AS "at"
FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY doc_id, lineno) AS r FROM lines WHERE regexp_matches(line, '(?m)^th\w+')) WHERE r <= 100""".replace(TH + "x?", r"^th\w+").replace(TH, r"^th\w+"))
def txt_sentences(spark, sf_dir):
    return textsearch.sentences(R.document_lines(spark, sf_dir), textsearch.compiled(r"^th\w+"))


@query("txt_extract", rf"WITH {R.LINES_SQL} SELECT * FROM lines WHERE (corpus, doc_id, lineno) IN (SELECT (corpus, doc_id, lineno) FROM lines WHERE regexp_matches(line, '[0-9]{{4}}'))")
def txt_extract(spark, sf_dir):
    lines = R.document_lines(spark, sf_dir)
    key = ["corpus", "doc_id", "lineno"]
    return textsearch.extract(lines, textsearch.indices(lines, textsearch.compiled("[0-9]{4}"), key), key)


@query("txt_slice", rf"WITH {R.LINES_SQL} SELECT corpus, sum({_n(TH, 'line')})::BIGINT AS n FROM lines WHERE lineno BETWEEN 2 AND 5 GROUP BY corpus")
def txt_slice(spark, sf_dir):
    lines = R.document_lines(spark, sf_dir).where(F.col("lineno").between(2, 5))
    return textsearch.counts(lines, textsearch.compiled(TH), text="line")


@query("txt_info", rf"""WITH {R.LINES_SQL}
SELECT corpus, count(*) AS sentences, sum(len(list_filter(string_split_regex(line, '[ \t\r\f\x0b]+'), lambda x: x <> '')))::BIGINT AS words, sum(length(line))::BIGINT AS chars FROM lines GROUP BY corpus""")
def txt_info(spark, sf_dir):
    return textsearch.info(R.document_lines(spark, sf_dir))


@query("txt_overview", rf"""
SELECT source AS corpus, count(*) AS texts, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, round(quantile_cont(n, 0.25), 6) AS p25,
  round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, max(n) AS most
FROM (SELECT source, {_n(TH)}::BIGINT AS n FROM documents) GROUP BY source""")
def txt_overview(spark, sf_dir):
    per = _docs(spark, sf_dir).select("corpus", textsearch.n_matches(F.col("text"), textsearch.compiled(TH)).alias("n"))
    return textsearch.overview(per, "corpus", "n")


@query("txt_dispersion", rf"""WITH {R.LINES_SQL},
m AS (SELECT corpus, doc_id, lineno, lineno - row_number() OVER (PARTITION BY corpus, doc_id ORDER BY lineno) AS run FROM lines WHERE regexp_matches(line, '(?m){TH}'))
SELECT corpus, doc_id, min(lineno) AS first, max(lineno) AS last, count(*) AS n FROM m GROUP BY corpus, doc_id, run""")
def txt_dispersion(spark, sf_dir):
    key = ["corpus", "doc_id", "lineno"]
    return textsearch.islands(textsearch.indices(R.document_lines(spark, sf_dir), textsearch.compiled(TH), key), ["corpus", "doc_id"], "lineno")


def _tokenize_sql(c: str) -> str:
    t = f"regexp_replace({c}, '([,;:@#$%&?!\\[\\](){{}}<>\"])', ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '([^.])(\\.)([\\])}}>\"'']*)\\s*$', '\\1 \\2 \\3 ', 'g')"
    t = f"regexp_replace({t}, '--', ' -- ', 'g')"
    for p in textsearch.CONTRACTIONS:
        t = f"regexp_replace({t}, '(?i){p.replace(chr(39), chr(39) * 2)}\\b', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"


@query("txt_tokenize", rf"WITH {R.LINES_SQL} SELECT corpus, doc_id, lineno, len({_tokenize_sql('line')})::INT AS n, array_to_string({_tokenize_sql('line')}, '|') AS words FROM lines")
def txt_tokenize(spark, sf_dir):
    x = R.document_lines(spark, sf_dir).withColumn("w", textsearch.tokenize(F.col("line")))
    return x.select("corpus", "doc_id", "lineno", F.size("w").alias("n"), F.array_join("w", "|").alias("words"))


@query("txt_escape", r"""
SELECT doc_id, replace(replace(text, '(', '#LRB#'), ')', '#RRB#') AS escaped, replace(replace(replace(replace(replace(replace(text, '(', '-LRB-'), ')', '-RRB-'), '[', '-LSB-'), ']', '-RSB-'), '{', '-LCB-'), '}', '-RCB-') AS ptb, true AS back
FROM documents""")
def txt_escape(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", textsearch.escape(t).alias("escaped"), textsearch.ptb_escape(t).alias("ptb"), (textsearch.unescape(textsearch.escape(t)) == t).alias("back"))


@query("txt_edit_distance", "SELECT p_partkey, levenshtein(p_brand, p_type)::INT AS d FROM part")
def txt_edit_distance(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_brand", "p_type").alias("d"))


def _signature_sql(first: str = "false") -> str:
    """Model 6 of the published unknown-word models."""
    capitals = f"len(regexp_extract_all(word, '[{textsearch.UPPER}]'))"
    endings = " ".join(f"WHEN ends_with(lower(word), '{e}') THEN '-{e}'" for e in textsearch.ENDINGS)
    return f"""'_UNK' || CASE WHEN {capitals} > 1 THEN '-CAPS' WHEN {capitals} = 1 AND {first} THEN '-INITC' WHEN {capitals} = 1 THEN '-CAP' WHEN regexp_matches(word, '[{textsearch.LOWER}]') THEN '-LC' ELSE '' END
  || CASE WHEN regexp_matches(word, '[0-9]') THEN '-NUM' ELSE '' END || CASE WHEN contains(word, '-') THEN '-DASH' ELSE '' END
  || CASE WHEN ends_with(lower(word), 's') AND length(word) >= 3 THEN CASE WHEN lower(word)[-2] IN ('s', 'i', 'u') THEN '' ELSE '-s' END
    WHEN length(word) >= 5 AND NOT contains(word, '-') AND NOT (regexp_matches(word, '[0-9]') AND {capitals} > 0) THEN CASE {endings} ELSE '' END ELSE '' END"""


_SIGNATURE_SQL = _signature_sql()
_SIGNATURE_4_SQL = f"""'_UNK' || CASE WHEN regexp_matches(word, '^[{textsearch.UPPER}]') THEN CASE WHEN NOT regexp_matches(word, '[{textsearch.LOWER}]') THEN '-AC' WHEN pos = 0 THEN '-SC' ELSE '-C' END
  WHEN regexp_matches(word, '[{textsearch.LOWER}]') THEN '-L' WHEN regexp_matches(word, '[{textsearch.UPPER}]') THEN '-U' ELSE '-S' END
  || CASE WHEN regexp_matches(word, '[0-9]') THEN CASE WHEN regexp_matches(word, '[^0-9]') THEN '-n' ELSE '-N' END ELSE '' END
  || CASE WHEN contains(word, '-') THEN '-H' ELSE '' END || CASE WHEN contains(word, '.') THEN '-P' ELSE '' END || CASE WHEN contains(word, ',') THEN '-C' ELSE '' END
  || CASE WHEN length(word) > 3 AND regexp_matches(word, '[{textsearch.LOWER}{textsearch.UPPER}]$') THEN '-' || lower(right(word, 2)) ELSE '' END"""


@query("txt_signatures_4", f"WITH {R.TOKENS_SQL} SELECT {_SIGNATURE_4_SQL} AS sig, count(*) AS n FROM tokens GROUP BY ALL")
def txt_signatures_4(spark, sf_dir):
    words = R.tokens(spark, sf_dir).groupBy("word", (F.col("pos") == 0).alias("first")).agg(F.count("*").alias("n"))
    return words.groupBy(textsearch.signature(F.col("word"), "4", F.col("first")).alias("sig")).agg(F.sum("n").alias("n"))


@query("txt_signatures_initial", f"WITH {R.TOKENS_SQL} SELECT {_signature_sql('pos = 0')} AS sig, count(*) AS n FROM tokens GROUP BY ALL")
def txt_signatures_initial(spark, sf_dir):
    words = R.tokens(spark, sf_dir).groupBy("word", (F.col("pos") == 0).alias("first")).agg(F.count("*").alias("n"))
    return words.groupBy(textsearch.signature(F.col("word"), first=F.col("first")).alias("sig")).agg(F.sum("n").alias("n"))


@query("txt_signatures", f"WITH {R.TOKENS_SQL} SELECT {_SIGNATURE_SQL} AS sig, count(*) AS n FROM tokens GROUP BY ALL")
def txt_signatures(spark, sf_dir):
    return R.tokens(spark, sf_dir).groupBy(textsearch.signature(F.col("word")).alias("sig")).agg(F.count("*").alias("n"))


@query("txt_guess_language", rf"""WITH {R.TOKENS_SQL},
d AS (SELECT t.*, documents.lang FROM tokens t JOIN documents USING (doc_id)),
lex AS (SELECT lang AS model, word, -ln(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY lang)) AS cost FROM d GROUP BY lang, word),
q AS (SELECT doc_id, word, count(*) AS k FROM tokens GROUP BY ALL),
s AS (SELECT doc_id, model, sum(k * cost) AS cost, sum(k) AS hits FROM q JOIN lex USING (word) GROUP BY ALL),
t AS (SELECT doc_id, sum(k) AS total FROM q GROUP BY ALL)
SELECT t.doc_id, arg_min(model, (round(cost + (total - hits) * -ln(1e-20), 9), model)) AS model FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id""")
def txt_guess_language(spark, sf_dir):
    """Every whole document, by a lexicon of all documents (its own words are in it, so agreement with lang says nothing)."""
    langs = R.table(spark, sf_dir, "documents").select("doc_id", "lang")
    words = staged(R.tokens(spark, sf_dir).groupBy("doc_id", "word").agg(F.count("*").alias("k")))  # texts are gone through once
    rows = staged(words.join(langs, "doc_id").groupBy(F.col("lang").alias("model"), "word").agg(F.sum("k").alias("n")))
    total = rows.groupBy(F.col("model").alias("of")).agg(F.sum("n").alias("all"))
    lexicon = rows.join(F.broadcast(total), F.col("model").eqNullSafe(F.col("of"))).select("model", "word", (-F.log(F.col("n") / F.col("all"))).alias("cost"))
    return textsearch.guess_language(words, lexicon, key="doc_id")


@query("txt_lexicon_model", f"WITH {R.TOKENS_SQL} SELECT tag, count(*) AS n, count(DISTINCT lower(word)) AS words, count(DISTINCT lower(word)) >= 50 AS open FROM tokens GROUP BY tag")
def txt_lexicon_model(spark, sf_dir):
    return grammar.lexicon_model(R.tokens(spark, sf_dir))


_UNK_SQL = f"CASE WHEN regexp_matches(word, '^(19|20)[0-9][0-9]$') THEN '1970' WHEN regexp_matches(word, '^[0-9]+(?:[.,][0-9]+)*$') THEN '000' WHEN k IS NOT NULL THEN word ELSE {_SIGNATURE_SQL} END"


@query("txt_replace_rare", f"WITH {R.TOKENS_SQL}, known AS (SELECT word AS k FROM tokens GROUP BY word HAVING count(*) > 4) SELECT tag, unk, count(*) AS n FROM (SELECT tag, {_UNK_SQL} AS unk FROM tokens LEFT JOIN known ON word = k) GROUP BY ALL")
def txt_replace_rare(spark, sf_dir):
    counted = R.tokens(spark, sf_dir).groupBy("tag", "word").agg(F.count("*").alias("n"))
    return grammar.replaced_counts(counted, textsearch.signature)


@query("txt_replace_unseen", f"""WITH {R.TOKENS_SQL}, lex AS (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n\\t\\r\\f\\x0b]+')) AS w FROM benchmark)
SELECT coalesce(a.w, b.w, c.w, '_UNK') AS unk, count(*) AS n FROM (SELECT word, {_SIGNATURE_SQL} AS sig FROM tokens) t
LEFT JOIN lex a ON a.w = word LEFT JOIN lex b ON b.w = lower(word) LEFT JOIN lex c ON c.w = sig GROUP BY ALL""")
def txt_replace_unseen(spark, sf_dir):
    """All words of the documents, against the lexicon of another corpus."""
    words = R.tokens(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    lexicon = R.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \n\t\r\f\x0b]+")).alias("word"))
    return grammar.replace_unseen(words, lexicon, textsearch.signature).groupBy("unk").agg(F.sum("n").alias("n"))


@query("txt_smooth_lexicon", f"""WITH {R.TOKENS_SQL}, f AS (SELECT word, count(*) AS c FROM tokens GROUP BY word),
lex AS (SELECT tag, word, count(*)::DOUBLE AS n FROM tokens JOIN f USING (word) WHERE c > 4 GROUP BY ALL), rare AS (SELECT tag, word, count(*)::DOUBLE AS n FROM tokens JOIN f USING (word) WHERE c <= 4 GROUP BY ALL)
SELECT tag, word, sum(n) AS n FROM (SELECT * FROM lex UNION ALL SELECT * FROM rare UNION ALL SELECT DISTINCT tag, '_UNK', 0.01 FROM lex) GROUP BY ALL""")
def txt_smooth_lexicon(spark, sf_dir):
    t = R.tokens(spark, sf_dir).select("tag", "word")
    known = grammar.known_words(t).select("word")
    lex, rare = (t.join(known, "word", how).groupBy("tag", "word").agg(F.count("*").alias("n")) for how in ("left_semi", "left_anti"))
    return grammar.smooth_lexicon(lex, rare)


# --- trees and patterns ---

CORPORA_SQL = "SELECT DISTINCT o_orderpriority AS corpus FROM orders"


def _corpora(spark, sf_dir):
    return R.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("corpus")).distinct()


@query("tree_nodes", f"WITH {R.NODES_SQL} SELECT corpus, depth, is_word, count(*) AS n, sum(nid)::BIGINT AS nids, sum(last)::BIGINT AS lasts, sum(e - s)::BIGINT AS covered, sum(nchild)::BIGINT AS kids FROM nodes GROUP BY ALL")
def tree_nodes(spark, sf_dir):
    return R.order_nodes(spark, sf_dir).groupBy("corpus", "depth", "is_word").agg(F.count("*").alias("n"), F.sum("nid").alias("nids"), F.sum("last").alias("lasts"), F.sum(F.col("e") - F.col("s")).alias("covered"), F.sum("nchild").alias("kids"))


@query("tree_info", f"""WITH {R.NODES_SQL}, p AS (SELECT corpus, sentno, sum(is_word::INT) AS w, sum((NOT is_word)::INT) AS k FROM nodes GROUP BY ALL)
SELECT corpus, count(*) AS sentences, sum(w)::BIGINT AS words, sum(k)::BIGINT AS nodes, max(k)::BIGINT AS most_nodes FROM p GROUP BY corpus""")
def tree_info(spark, sf_dir):
    return treequery.info(R.order_nodes(spark, sf_dir))


@query("tree_fanout", f"""WITH {R.LEAVES_SQL}, r AS (SELECT *, leaf - row_number() OVER (PARTITION BY sentno, label ORDER BY leaf) AS run FROM leaves)
SELECT sentno, label, count(DISTINCT run) AS fanout FROM r GROUP BY ALL""")
def tree_fanout(spark, sf_dir):
    return grammar.fanout(R.user_leaves(spark, sf_dir), ["sentno", "label"])


@query("tree_spans", f"""WITH {R.LEAVES_SQL}, r AS (SELECT *, leaf - row_number() OVER (PARTITION BY sentno, label ORDER BY leaf) AS run FROM leaves)
SELECT sentno, label, min(leaf) AS first, max(leaf) AS last FROM r GROUP BY sentno, label, run""")
def tree_spans(spark, sf_dir):
    return grammar.spans(R.user_leaves(spark, sf_dir), ["sentno", "label"])


@query("tree_yield_functions", f"""WITH {R.LEAVES_SQL}, f AS (SELECT sentno, label, row_number() OVER (PARTITION BY sentno ORDER BY min(leaf)) - 1 AS child FROM leaves GROUP BY sentno, label),
x AS (SELECT l.sentno, leaf, child, lag(child) OVER (PARTITION BY l.sentno ORDER BY leaf) AS bef FROM leaves l JOIN f USING (sentno, label))
SELECT sentno, string_agg(child::VARCHAR, '' ORDER BY leaf) AS yf FROM x WHERE bef IS NULL OR bef <> child GROUP BY sentno""")
def tree_yield_functions(spark, sf_dir):
    return grammar.yield_functions(R.user_leaves(spark, sf_dir))


@query("tree_heights", f"WITH {R.NODES_SQL} SELECT a.corpus, a.label, max(b.depth) - min(a.depth) + 1 AS height, count(*) AS n FROM nodes a JOIN nodes b ON a.sentno = b.sentno AND a.nid <= b.nid AND b.nid <= a.last WHERE a.depth < 1 GROUP BY a.corpus, a.label")
def tree_heights(spark, sf_dir):
    x = R.order_nodes(spark, sf_dir)
    a = x.where("depth < 1").select("corpus", "label", F.col("sentno").alias("s2"), F.col("nid").alias("top"), F.col("last").alias("upto"), F.col("depth").alias("d0"))
    j = a.join(x.select("sentno", "nid", "depth"), (F.col("s2") == F.col("sentno")) & (F.col("top") <= F.col("nid")) & (F.col("nid") <= F.col("upto")))
    return j.groupBy("corpus", "label").agg((F.max("depth") - F.min("d0") + 1).alias("height"), F.count("*").alias("n"))


#: Name, pattern, and the SQL condition between a and b.
_BELOW = "a.nid < b.nid AND b.nid <= a.last"
_SISTER = "a.parent = b.parent"
AXES = (
    ("parent", "/^ORD/ < NO", "b.parent = a.nid"), ("child", "NO > /^ORD/", "a.parent = b.nid"), ("nth", "/^ORD/ <2 NO", "b.parent = a.nid AND b.ix = 2"), ("nth_of", "NO >2 /^ORD/", "a.parent = b.nid AND a.ix = 2"),
    ("first", "/^ORD/ <, NO", "b.parent = a.nid AND b.ix = 1"), ("first_of", "NO >, /^ORD/", "a.parent = b.nid AND a.ix = 1"), ("nth_last", "/^ORD/ <-2 NO", "b.parent = a.nid AND b.ix = a.nchild - 1"), ("nth_last_of", "NO >-2 /^ORD/", "a.parent = b.nid AND a.ix = b.nchild - 1"),
    ("last", "/^ORD/ <- NO", "b.parent = a.nid AND b.ix = a.nchild"), ("last_of", "NO >` /^ORD/", "a.parent = b.nid AND a.ix = b.nchild"), ("only", "/^ORD/ <: NO", "b.parent = a.nid AND a.nchild = 1"), ("only_of", "NO >: /^ORD/", "a.parent = b.nid AND b.nchild = 1"),
    ("dominates", "/^ORD/ << w7", _BELOW), ("dominated", "w7 >> /^ORD/", "b.nid < a.nid AND a.nid <= b.last"), ("leftmost", "/^ORD/ <<, w7", f"{_BELOW} AND a.s = b.s"), ("leftmost_of", "w7 >>, /^ORD/", "b.nid < a.nid AND a.nid <= b.last AND a.s = b.s"),
    ("rightmost", "/^ORD/ <<` w7", f"{_BELOW} AND a.e = b.e"), ("rightmost_of", "w7 >>` /^ORD/", "b.nid < a.nid AND a.nid <= b.last AND a.e = b.e"), ("single_path", "* <<: w7", f"{_BELOW} AND a.s = b.s AND a.e = b.e"), ("single_path_of", "w7 >>: *", "b.nid < a.nid AND a.nid <= b.last AND a.s = b.s AND a.e = b.e"),
    ("precedes", "NO . RF", "a.e = b.s"), ("follows", "NO , RF", "b.e = a.s"), ("before", "NO .. RF", "a.e <= b.s"), ("after", "NO ,, RF", "b.e <= a.s"),
    ("sister", "NO $ RF", f"{_SISTER} AND a.nid <> b.nid"), ("next_sister", "NO $. RF", f"{_SISTER} AND a.ix + 1 = b.ix"), ("previous_sister", "NO $, RF", f"{_SISTER} AND b.ix + 1 = a.ix"), ("later_sister", "NO $.. RF", f"{_SISTER} AND a.ix < b.ix"), ("earlier_sister", "NO $,, RF", f"{_SISTER} AND b.ix < a.ix"),
    ("same", "NO = NO", "a.nid = b.nid"),
)


def _sql_test(test: str, x: str) -> str:
    return "true" if test == "*" else f"regexp_matches({x}.label, '{test[1:-1]}')" if test[0] == "/" else f"{x}.label = '{test}'"


def _axis(name: str, pattern: str, on: str) -> None:
    a, _, b = pattern.split(" ")

    @query(f"tg_{name}", f"WITH {R.NODES_SQL} SELECT a.corpus, count(*) AS n FROM nodes a JOIN nodes b ON a.sentno = b.sentno AND {on} WHERE {_sql_test(a, 'a')} AND {_sql_test(b, 'b')} GROUP BY a.corpus")
    def run(spark, sf_dir):
        return treequery.counts(R.order_nodes(spark, sf_dir), pattern)


for _x in AXES:
    _axis(*_x)


@query("tg_negation", f"WITH {R.NODES_SQL} SELECT corpus, count(*) AS n FROM nodes a WHERE regexp_matches(label, '^ORD') AND NOT EXISTS (SELECT 1 FROM nodes b WHERE b.sentno = a.sentno AND b.parent = a.nid AND b.label = 'NO') GROUP BY corpus")
def tg_negation(spark, sf_dir):
    return treequery.counts(R.order_nodes(spark, sf_dir), "/^ORD/ !< NO")


@query("tg_nested", f"""WITH {R.NODES_SQL} SELECT a.corpus, count(*) AS n FROM nodes a JOIN nodes b ON b.sentno = a.sentno AND b.parent = a.nid AND b.label = 'NO' JOIN nodes c ON c.sentno = b.sentno AND c.parent = b.parent AND c.ix = b.ix + 1 AND c.label = 'RF'
WHERE regexp_matches(a.label, '^ORD') AND NOT EXISTS (SELECT 1 FROM nodes d WHERE d.sentno = b.sentno AND d.parent = b.nid AND d.label = 'w7') GROUP BY a.corpus""")
def tg_nested(spark, sf_dir):
    return treequery.counts(R.order_nodes(spark, sf_dir), "/^ORD/ < (NO $. RF !< w7)")


@query("tg_alternatives", f"WITH {R.NODES_SQL} SELECT corpus, count(*) AS n FROM nodes a WHERE regexp_matches(label, '^ORD') AND EXISTS (SELECT 1 FROM nodes b WHERE b.sentno = a.sentno AND b.parent = a.nid AND (b.label = 'AF' AND b.ix = 1 OR b.label = 'RF' AND b.ix = a.nchild)) GROUP BY corpus")
def tg_alternatives(spark, sf_dir):
    return treequery.counts(R.order_nodes(spark, sf_dir), "/^ORD/ [<, AF | <- RF]")


@query("tg_named", f"WITH {R.NODES_SQL} SELECT a.corpus, count(*) AS n FROM nodes a JOIN nodes b ON b.sentno = a.sentno AND b.parent = a.nid AND b.label = 'NO' JOIN nodes c ON c.sentno = a.sentno AND c.parent = a.nid AND c.label IN ('RF', 'AF') WHERE regexp_matches(a.label, '^ORD') AND c.ix = b.ix + 1 GROUP BY a.corpus")
def tg_named(spark, sf_dir):
    return treequery.counts(R.order_nodes(spark, sf_dir), "/^ORD/ < NO=x < (RF|AF $, =x)")


@query("tg_macro", f"WITH {R.NODES_SQL} SELECT a.corpus, count(*) AS n FROM nodes a JOIN nodes b ON b.sentno = a.sentno AND b.parent = a.nid WHERE regexp_matches(a.label, '^ORD') AND b.label IN ('RF', 'AF') GROUP BY a.corpus")
def tg_macro(spark, sf_dir):
    return treequery.counts(R.order_nodes(spark, sf_dir), "{order} < {done}", macros={"order": "/^ORD/", "done": "RF|AF"})


@query("tg_zero_counts", f"SELECT corpus, 0::BIGINT AS n FROM ({CORPORA_SQL})")
def tg_zero_counts(spark, sf_dir):
    return treequery.counts(R.order_nodes(spark, sf_dir), "XX < YY", _corpora(spark, sf_dir))


@query("tg_slice", f"WITH {R.NODES_SQL} SELECT corpus, count(*) AS n FROM nodes WHERE label = 'NO' AND sentno BETWEEN 100 AND 5000 GROUP BY corpus")
def tg_slice(spark, sf_dir):
    return treequery.counts(R.order_nodes(spark, sf_dir), "NO", start=100, end=5000)


@query("tg_indices", f"WITH {R.NODES_SQL} SELECT corpus, sentno, count(*) AS n FROM nodes WHERE label = 'NO' GROUP BY ALL")
def tg_indices(spark, sf_dir):
    return treequery.indices(R.order_nodes(spark, sf_dir), "NO")


@query("tg_breakdown", f"WITH {R.NODES_SQL} SELECT a.corpus, b.word AS match, count(*) AS n FROM nodes a JOIN nodes b ON b.sentno = a.sentno AND b.parent = a.nid WHERE a.label = 'NO' GROUP BY ALL")
def tg_breakdown(spark, sf_dir):
    return treequery.breakdown(R.order_nodes(spark, sf_dir), "NO")


@query("tg_batch_counts", f"""WITH {R.NODES_SQL}, m AS (SELECT corpus, count(*) FILTER (label = 'NO') AS no, count(*) FILTER (label = 'w7') AS w7, 0::BIGINT AS none FROM nodes GROUP BY corpus)
SELECT c.corpus, coalesce(no, 0) AS no, coalesce(w7, 0) AS w7, coalesce(none, 0) AS none FROM ({CORPORA_SQL}) c LEFT JOIN m USING (corpus)""")
def tg_batch_counts(spark, sf_dir):
    return treequery.batch_counts(R.order_nodes(spark, sf_dir), _corpora(spark, sf_dir), {"no": "NO", "w7": "w7", "none": "XX"})


@query("tg_sentences", f"WITH {R.NODES_SQL}, m AS (SELECT corpus, sentno, min(nid) AS nid, count(*) AS n_matches FROM nodes WHERE label = 'w7' GROUP BY ALL) SELECT corpus, sentno, nid, n_matches FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY sentno) AS r FROM m) WHERE r <= 100")
def tg_sentences(spark, sf_dir):
    return treequery.first_sentences(R.order_nodes(spark, sf_dir), "w7")


_STORED_NODES_SQL = R.NODES_SQL.replace("items AS (", "items AS MATERIALIZED (", 1).replace("nodes AS (", "nodes AS MATERIALIZED (", 1)


@query("tg_subtrees", f"WITH {_STORED_NODES_SQL} SELECT b.corpus, b.sentno, a.nid AS top, b.nid, b.label, b.is_word FROM nodes a JOIN nodes b ON a.sentno = b.sentno AND a.nid <= b.nid AND b.nid <= a.last WHERE a.label = 'AF'")
def tg_subtrees(spark, sf_dir):
    return treequery.subtrees(R.order_nodes(spark, sf_dir), "AF")


# --- grammars ---

_GRAMMAR_SQL = R.NODES_SQL + """,
gram AS (
  SELECT label AS lhs, 'Epsilon' AS rhs, w AS word, count(*) AS n FROM (SELECT a.label, b.word AS w FROM nodes a JOIN nodes b ON a.sentno = b.sentno AND b.parent = a.nid WHERE b.is_word) GROUP BY ALL
  UNION ALL SELECT lhs, rhs, NULL, count(*) FROM (SELECT any_value(a.label) AS lhs, string_agg(b.label, ' ' ORDER BY b.ix) AS rhs FROM nodes a JOIN nodes b ON a.sentno = b.sentno AND b.parent = a.nid WHERE NOT b.is_word GROUP BY a.sentno, a.nid) GROUP BY ALL)"""


def _grammar(spark, sf_dir):
    return grammar.treebank_grammar(grammar.productions(R.order_nodes(spark, sf_dir)))


def _flat(g):
    return g.withColumn("rhs", F.array_join("rhs", " "))


@query("gram_treebank", f"WITH {_GRAMMAR_SQL} SELECT * FROM gram")
def gram_treebank(spark, sf_dir):
    return _flat(_grammar(spark, sf_dir))


@query("gram_relative", f"WITH {_GRAMMAR_SQL} SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY lhs) AS p FROM gram")
def gram_relative(spark, sf_dir):
    return _flat(grammar.relative(_grammar(spark, sf_dir)))


@query("gram_sums_to_one", f"WITH {_GRAMMAR_SQL} SELECT DISTINCT lhs, true AS ok FROM gram")
def gram_sums_to_one(spark, sf_dir):
    return grammar.sums_to_one(grammar.relative(_grammar(spark, sf_dir))).select("lhs", (F.col("off") < 1e-9).alias("ok"))


@query("gram_statistics", f"WITH {_GRAMMAR_SQL} SELECT lhs, count(*) AS rules, count(word) AS lexical, sum(n)::BIGINT AS mass FROM gram GROUP BY lhs")
def gram_statistics(spark, sf_dir):
    return grammar.statistics(_grammar(spark, sf_dir))


@query("gram_complexity", f"WITH {_GRAMMAR_SQL} SELECT len(string_split(rhs, ' '))::INT AS arity, count(*) AS rules, sum(n)::BIGINT AS mass FROM gram GROUP BY ALL")
def gram_complexity(spark, sf_dir):
    return grammar.complexity(_grammar(spark, sf_dir))


_HALVES_SQL = _GRAMMAR_SQL.replace("gram AS (", "unused AS (") + """,
h AS (SELECT *, sentno % 2 AS half FROM nodes),
lex AS (SELECT half, label AS lhs, 'Epsilon' AS rhs, w AS word, count(*) AS n FROM (SELECT a.half, a.label, b.word AS w FROM h a JOIN h b ON a.sentno = b.sentno AND b.parent = a.nid WHERE b.is_word) GROUP BY ALL),
big AS (SELECT half, lhs, rhs, NULL::VARCHAR AS word, count(*) AS n FROM (SELECT any_value(a.half) AS half, any_value(a.label) AS lhs, string_agg(b.label, ' ' ORDER BY b.ix) AS rhs FROM h a JOIN h b ON a.sentno = b.sentno AND b.parent = a.nid WHERE NOT b.is_word GROUP BY a.sentno, a.nid) GROUP BY ALL),
two AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY half, lhs) AS p FROM (SELECT * FROM lex UNION ALL SELECT * FROM big))"""


def _halves(spark, sf_dir):
    p = grammar.productions(R.order_nodes(spark, sf_dir))
    return [grammar.relative(grammar.treebank_grammar(p.where(F.col("sentno") % 2 == k))) for k in (0, 1)]


@query("gram_merge", f"WITH {_HALVES_SQL} SELECT lhs, rhs, word, sum(p) / 2 AS p FROM two GROUP BY ALL")
def gram_merge(spark, sf_dir):
    return _flat(grammar.merge(_halves(spark, sf_dir)))


@query("gram_subset", f"WITH {_HALVES_SQL} SELECT lhs, rhs, word, n FROM two a WHERE half = 0 AND NOT EXISTS (SELECT 1 FROM two b WHERE b.half = 1 AND b.lhs = a.lhs AND b.rhs = a.rhs AND b.word IS NOT DISTINCT FROM a.word)")
def gram_subset(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return _flat(grammar.not_in(a, b)).select("lhs", "rhs", "word", "n")


@query("gram_augment", f"WITH {_GRAMMAR_SQL} SELECT * FROM gram")
def gram_augment(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return _flat(grammar.augment(a, b))


@query("gram_subtree_counts", f"WITH {R.NODES_SQL} SELECT corpus, sentno, nid, depth, CASE WHEN depth = 0 THEN pow(2, nchild) ELSE 1 END::DOUBLE AS n FROM nodes WHERE NOT is_word")
def gram_subtree_counts(spark, sf_dir):
    return grammar.subtree_counts(R.order_nodes(spark, sf_dir), 1)


@query("gram_dop_reduction", f"""WITH {R.BINARIZED_SQL},
a AS (SELECT sentno, nid, unnest([label, label || '@' || sentno || '-' || nid]) AS lhs, "left", CASE WHEN contains("right", '|<') THEN ["right", "right" || '@' || sentno || '-' || (nid + 1)] ELSE ["right"] END AS sides FROM prods),
b AS (SELECT lhs, "left" || ' ' || unnest(sides) AS rhs FROM a) SELECT lhs, rhs, count(*) AS n FROM b GROUP BY ALL""")
def gram_dop_reduction(spark, sf_dir):
    return grammar.dop_reduction(R.binarized_nodes(spark, sf_dir))


@query("gram_markov_threshold", f"WITH {R.BINARIZED_SQL} SELECT label, CASE WHEN count(*) < 500 THEN regexp_replace(label, '\\|<.*', '') ELSE label END AS new FROM prods GROUP BY label")
def gram_markov_threshold(spark, sf_dir):
    return grammar.markov_threshold(R.binarized_nodes(spark, sf_dir), 500, lambda c: F.regexp_replace(c, r"\|<.*", ""))


@query("gram_coarse", f"WITH {R.BINARIZED_SQL} SELECT DISTINCT label, regexp_replace(label, '\\|<.*', '') AS coarse FROM prods")
def gram_coarse(spark, sf_dir):
    return grammar.coarse(R.binarized_nodes(spark, sf_dir).withColumnRenamed("label", "lhs"), r"\|<.*")


# In right-factored trees a node over one closed child has one fragment more than that child.
_DOP_SQL = "WITH RECURSIVE " + R.factored_sql("right") + """,
c AS (SELECT n.*, (max(depth) OVER (PARTITION BY sentno) - depth + 1)::DOUBLE AS a FROM fnodes n),
m AS (SELECT label, sum(a) AS mass, count(*) AS nodes FROM c GROUP BY label),
j AS (
  SELECT c.label, c.label || '@' || c.sentno || '-' || c.nid AS own, c.prod[len(c.label) + 2:] AS rhs, c.a, m.mass, m.nodes, k.a AS ka, k.label || '@' || k.sentno || '-' || k.nid AS kid, k.label AS klabel
  FROM c JOIN m ON m.label = c.label LEFT JOIN c k ON k.sentno = c.sentno AND k.parent = c.nid),
e AS (
  SELECT label, own, a, mass, nodes, rhs, 1.0::DOUBLE AS u FROM j UNION ALL SELECT label, own, a, mass, nodes, rhs[:len(rhs) - len(klabel)] || kid, ka FROM j WHERE ka IS NOT NULL),
r AS (
  SELECT label AS lhs, rhs, u / mass AS relative, u / a / nodes AS equal, 0.5 AS shortest FROM e UNION ALL SELECT own, rhs, u / a, u / a, 1.0 FROM e)
"""


def _dop(spark, sf_dir, estimate):
    return grammar.dop_weights(R.factored_nodes(spark, sf_dir, "right"), estimate).withColumn("w", F.round("w", 9))


@query("gram_dop_relative", _DOP_SQL + "SELECT lhs, rhs, count(*) AS n, round(sum(relative), 9) AS w FROM r GROUP BY ALL")
def gram_dop_relative(spark, sf_dir):
    return _dop(spark, sf_dir, "relative")


@query("gram_dop_equal", _DOP_SQL + "SELECT lhs, rhs, count(*) AS n, round(sum(equal), 9) AS w FROM r GROUP BY ALL")
def gram_dop_equal(spark, sf_dir):
    return _dop(spark, sf_dir, "equal")


@query("gram_dop_shortest", _DOP_SQL + "SELECT lhs, rhs, count(*) AS n, any_value(shortest)::DOUBLE AS w FROM r GROUP BY ALL")
def gram_dop_shortest(spark, sf_dir):
    return _dop(spark, sf_dir, "shortest")


# --- fragments ---


@query("frag_index", f"WITH {R.BINARIZED_SQL} SELECT prod, count(DISTINCT sentno) AS trees, count(*) AS n FROM prods GROUP BY prod")
def frag_index(spark, sf_dir):
    return fragments.production_index(R.binarized_nodes(spark, sf_dir))


# Fragments of each shape: a chain with a word, one that branches, a root with one child, one that does not occur.
FRAGMENTS = {
    "right": {
        "chain": "(ORD-O (NO ) (ORD-O|<NO,NO> (NO w7) (ORD-O|<NO,NO> )))", "deep": "(ORD-F|<RF,RF> (RF ) (ORD-F|<RF,RF> (RF ) (ORD-F|<RF,RF> (RF ) (RF ))))",
        "unary": "(ORD-F (AF ))", "word": "(NO w7)", "none": "(ORD-O (XX ) (NO ))",
    },
    "left": {
        "chain": "(ORD-O (ORD-O|<NO,NO> (ORD-O|<NO,NO> ) (NO w7)) (NO ))", "deep": "(ORD-F|<RF,RF> (ORD-F|<RF,RF> (ORD-F|<RF,RF> (RF ) (RF )) (RF )) (RF ))",
        "unary": "(ORD-F (AF w7))", "word": "(RO w49)", "none": "(ORD-O (XX ) (NO ))",
    },
    "balanced": {
        "both": "(ORD-O (ORD-O|<NO,NO> (NO ) (NO )) (ORD-O|<NO,NO> (NO ) (NO )))", "words": "(ORD-O|<NO,NO> (NO w7) (NO ))", "mixed": "(ORD-O (ORD-O|<NO,NO> ) (ORD-O|<NO,NO> (NO ) (NO w7)))",
        "deep": "(ORD-O (ORD-O|<NO,NO> (ORD-O|<NO,NO> (NO ) (NO )) (NO )) (ORD-O|<NO,NO> ))", "unary": "(ORD-P (NO ))", "none": "(ORD-O (XX ) (NO ))",
    },
}


def _twig_sql(name: str, text: str, out: str = "n0.corpus, n0.sentno, n0.nid") -> str:
    """One fragment as a chain of self-joins on parent and slot."""
    tables, conditions = [], []

    def walk(node, above, slot):
        me = f"n{len(tables)}"
        tables.append(f"fnodes {me}")
        label, kids = node
        over = f"={kids[0]}" if isinstance(kids[0], str) else " ".join(k[0] for k in kids)
        conditions.append(f"{me}.prod = '{label} {over}'")
        if above:
            conditions.append(f"{me}.sentno = {above}.sentno AND {me}.parent = {above}.nid AND {me}.side = {slot}")
        for i, k in enumerate(kids, 1):
            if not isinstance(k, str) and k[1]:
                walk(k, me, i)

    walk(fragments.parsed(text), None, None)
    return f"SELECT '{name}' AS frag, {out} FROM {', '.join(tables)} WHERE {' AND '.join(conditions)}"


def _batch_sql(shape: str) -> str:
    return "\nUNION ALL ".join(_twig_sql(n, t) for n, t in FRAGMENTS[shape].items())


@query("frag_search_right", f"WITH RECURSIVE {R.factored_sql('right', True)} {_batch_sql('right')}")
def frag_search_right(spark, sf_dir):
    return fragments.search(R.factored_nodes(spark, sf_dir, "right", words=True), FRAGMENTS["right"])


@query("frag_search_left", f"WITH RECURSIVE {R.factored_sql('left', True)} {_batch_sql('left')}")
def frag_search_left(spark, sf_dir):
    return fragments.search(R.factored_nodes(spark, sf_dir, "left", words=True), FRAGMENTS["left"])


@query("frag_search", f"WITH RECURSIVE {R.factored_sql('balanced', True)} {_batch_sql('balanced')}")
def frag_search(spark, sf_dir):
    return fragments.search(R.factored_nodes(spark, sf_dir, "balanced", words=True), FRAGMENTS["balanced"])


@query("frag_batch_counts", f"""WITH RECURSIVE {R.factored_sql('balanced', True)}, m AS ({_batch_sql('balanced')}), f AS (SELECT unnest({list(FRAGMENTS['balanced'])}) AS frag)
SELECT f.frag, count(m.nid) AS n FROM f LEFT JOIN m ON m.frag = f.frag GROUP BY f.frag""")
def frag_batch_counts(spark, sf_dir):
    return fragments.counts(frag_search(spark, sf_dir), FRAGMENTS["balanced"])


@query("frag_counts_by_corpus", f"WITH RECURSIVE {R.factored_sql('balanced', True)}, m AS ({_batch_sql('balanced')}) SELECT frag, corpus, count(*) AS n FROM m GROUP BY ALL")
def frag_counts_by_corpus(spark, sf_dir):
    return fragments.counts(frag_search(spark, sf_dir), FRAGMENTS["balanced"], ["corpus"])


@query("frag_candidates", f"""WITH RECURSIVE {R.factored_sql('balanced', True)}
SELECT 'mixed' AS frag, corpus, sentno FROM fnodes WHERE prod IN ('ORD-O ORD-O|<NO,NO> ORD-O|<NO,NO>', 'ORD-O|<NO,NO> NO NO', 'NO =w7') GROUP BY ALL HAVING count(DISTINCT prod) = 3""")
def frag_candidates(spark, sf_dir):
    return fragments.candidates(R.factored_nodes(spark, sf_dir, words=True), {"mixed": FRAGMENTS["balanced"]["mixed"]})


# Right-factored trees are chains of productions (ch: prods from a node down), so what two nodes share is a common prefix.
_CHAIN_SQL = R.factored_sql("right") + """,
links AS (SELECT sentno, nid, parent, depth, prod, label, seq, root FROM fnodes),
ch AS (
  SELECT n.corpus, n.sentno, n.nid, n.label AS root, n.side, any_value(u.prod) AS up, list(d.prod ORDER BY d.depth) AS p, list('(' || d.label || CASE WHEN len(d.seq) > 1 THEN ' (' || d.seq[1] || ' ) ' ELSE ' ' END ORDER BY d.depth) AS opens,
    list('(' || d.last || ' )' ORDER BY d.depth) AS ends
  FROM fnodes n JOIN (SELECT *, CASE len(seq) WHEN 1 THEN seq[1] WHEN 2 THEN seq[2] ELSE root || '|<' || seq[2] || ',' || seq[len(seq)] || '>' END AS last FROM links) d ON d.sentno = n.sentno AND d.depth >= n.depth
  LEFT JOIN links u ON u.sentno = n.sentno AND u.nid = n.parent GROUP BY n.corpus, n.sentno, n.nid, n.label, n.side),
kinds AS (SELECT p, up, any_value(root) AS root, any_value(opens) AS opens, any_value(ends) AS ends, min(sentno) AS lo, max(sentno) AS hi FROM ch GROUP BY p, up),
met AS (
  SELECT DISTINCT a.root, a.opens, a.ends, a.p, coalesce(list_position(list_transform(list_zip(a.p, b.p), lambda z: coalesce(z[1] = z[2], false)), false) - 1, len(a.p)) AS k
  FROM kinds a JOIN kinds b ON a.p[1] = b.p[1] AND a.p <= b.p AND (a.up IS NULL OR b.up IS NULL OR a.up <> b.up) AND NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo)),
found AS (SELECT DISTINCT root, p[1:k] AS p, array_to_string(opens[1:k], '') || ends[k] || repeat(')', k::INT) AS frag FROM met),
pre AS (SELECT p[1:k] AS p, corpus, sentno FROM (SELECT p, corpus, sentno, unnest(range(1, len(p) + 1)) AS k FROM ch)),
rec AS (SELECT root, frag, count(*) AS n FROM found JOIN pre USING (p) GROUP BY ALL)"""


def _recurring(spark, sf_dir):
    return fragments.recurring(R.factored_nodes(spark, sf_dir, "right"))


@query("frag_recurring", f"WITH RECURSIVE {_CHAIN_SQL} SELECT root, frag, n FROM rec")
def frag_recurring(spark, sf_dir):
    return _recurring(spark, sf_dir)


@query("frag_relative", f"WITH RECURSIVE {_CHAIN_SQL} SELECT root, frag, n, n::DOUBLE / sum(n) OVER (PARTITION BY root) AS rel FROM rec")
def frag_relative(spark, sf_dir):
    return fragments.relative(_recurring(spark, sf_dir))


@query("frag_ranking", rf"WITH RECURSIVE {_CHAIN_SQL}, w AS (SELECT *, len(regexp_extract_all(frag, ' \)')) AS open FROM rec) SELECT *, round(pow(open, 2) * sqrt(n), 6) AS score FROM w ORDER BY score DESC, frag LIMIT 250")
def frag_ranking(spark, sf_dir):
    """These trees have no words, so fragments count their open nodes."""
    return fragments.ranking(_recurring(spark, sf_dir).withColumn("open", fragments.n_open(F.col("frag"))), "open")


@query("frag_ewe", f"""WITH RECURSIVE {_CHAIN_SQL}, o AS (SELECT root, frag, sentno, 1.0::DOUBLE / count(*) OVER (PARTITION BY sentno) AS u FROM found JOIN pre USING (p)), s AS (SELECT root, frag, sum(u) AS u FROM o GROUP BY ALL)
SELECT root, frag, round(u / sum(u) OVER (PARTITION BY root), 9) AS w FROM s""")
def frag_ewe(spark, sf_dir):
    return fragments.ewe(R.factored_nodes(spark, sf_dir, "right")).withColumn("w", F.round("w", 9))


# Left-factored trees are chains downwards to the left.
@query("frag_common", "WITH RECURSIVE " + R.factored_sql("left") + """,
ch AS (
  SELECT n.corpus, n.sentno, n.nid, n.label AS root, any_value(u.prod) AS up, list(d.prod ORDER BY d.depth) AS p, list('(' || d.label || ' ' ORDER BY d.depth) AS opens,
    list(CASE WHEN len(d.seq) > 1 THEN ' (' || d.seq[len(d.seq)] || ' ))' ELSE ')' END ORDER BY d.depth) AS ends,
    list('(' || CASE WHEN len(d.seq) <= 2 THEN d.seq[1] ELSE d.root || '|<' || d.seq[1] || ',' || d.seq[len(d.seq) - 1] || '>' END || ' )' ORDER BY d.depth) AS mids
  FROM fnodes n JOIN fnodes d ON d.sentno = n.sentno AND d.depth >= n.depth LEFT JOIN fnodes u ON u.sentno = n.sentno AND u.nid = n.parent
  WHERE n.corpus IN ('1-URGENT', '2-HIGH') GROUP BY n.corpus, n.sentno, n.nid, n.label),
kinds AS (SELECT DISTINCT corpus, p, up, root, opens, ends, mids FROM ch),
met AS (
  SELECT DISTINCT a.root, a.opens, a.ends, a.mids, a.p, coalesce(list_position(list_transform(list_zip(a.p, b.p), lambda z: coalesce(z[1] = z[2], false)), false) - 1, len(a.p)) AS k
  FROM kinds a JOIN kinds b ON a.corpus = '1-URGENT' AND b.corpus = '2-HIGH' AND a.p[1] = b.p[1] AND (a.up IS NULL OR b.up IS NULL OR a.up <> b.up)),
found AS (SELECT DISTINCT root, p[1:k] AS p, array_to_string(opens[1:k], '') || mids[k] || array_to_string(list_reverse(ends[1:k]), '') AS frag FROM met),
pre AS (SELECT p[1:k] AS p FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM ch WHERE corpus = '2-HIGH'))
SELECT root, frag, count(*) AS n FROM found JOIN pre USING (p) GROUP BY ALL""")
def frag_common(spark, sf_dir):
    x = R.factored_nodes(spark, sf_dir, "left")
    high = x.where("corpus = '2-HIGH'")
    return fragments.recurring(x.where("corpus = '1-URGENT'"), high, count_in=high)


@query("frag_kernel", "WITH RECURSIVE " + R.factored_sql("balanced") + """,
t AS (SELECT root, seq, count(*) AS copies, min({'c': corpus, 's': sentno}) AS t FROM fnodes WHERE top GROUP BY ALL),
x AS (SELECT t.t, t.copies, prod, count(*) AS x FROM t JOIN fnodes f ON f.corpus = t.t.c AND f.sentno = t.t.s GROUP BY ALL)
SELECT a.t.c AS a_corpus, a.t.s AS a, b.t.c AS b_corpus, b.t.s AS b, sum(a.x * b.x)::BIGINT AS n FROM x a JOIN x b ON a.prod = b.prod AND (a.t < b.t OR (a.t = b.t AND a.copies > 1)) GROUP BY ALL""")
def frag_kernel(spark, sf_dir):
    return fragments.kernel(R.factored_nodes(spark, sf_dir, "balanced"))


# --- grammars of whole fragments ---

# Fragments fr (root, frag, n, u), of nodes `counted_nodes` by label, as rules.
_FLAT_SQL = r"""
lv AS (SELECT *, regexp_extract_all(frag, '\(([^\s()]+) ([^\s()]*)\)', 1) AS l, regexp_extract_all(frag, '\(([^\s()]+) ([^\s()]*)\)', 2) AS w, substr(md5(frag), 1, 16) AS id, regexp_full_match(frag, '\([^\s()]+ [^\s()]+\)') AS lexical FROM fr),
wt AS (
  SELECT lv.*, list_transform(list_zip(l, w), lambda z: CASE WHEN z[2] = '' THEN z[1] ELSE z[1] || '@' || z[2] END) AS t, len(l) AS k, n::DOUBLE / sum(n) OVER (PARTITION BY root) AS rel, u / sum(u) OVER (PARTITION BY root) AS ewe,
    pow(2.0, 1 - len(regexp_extract_all(frag, '\('))) * n / c.seen AS bon FROM lv JOIN (SELECT label, count(*) AS seen FROM fnodes GROUP BY label) c ON c.label = root),
rl AS (
  SELECT root AS lhs, CASE WHEN k <= 2 THEN root || '}<' || id || ':' || k || '>' ELSE root || '}<' || id || ':' || (k - 1) || '> ' || t[k] END AS rhs, NULL AS word, n, rel, ewe, bon, 0.5::DOUBLE AS shortest FROM wt WHERE NOT lexical
  UNION ALL SELECT root, 'Epsilon', w[1], n, rel, ewe, bon, 0.5 FROM wt WHERE lexical
  UNION ALL SELECT root || '}<' || id || ':' || j || '>', CASE WHEN j <= 2 THEN array_to_string(t[1:j], ' ') ELSE root || '}<' || id || ':' || (j - 1) || '> ' || t[j] END, NULL, 1, 1, 1, 1, 1
  FROM (SELECT *, unnest(CASE WHEN k <= 2 THEN [k] ELSE range(2, k) END) AS j FROM wt WHERE NOT lexical)
  UNION ALL SELECT DISTINCT x.a || '@' || x.b, 'Epsilon', x.b, 1, 1, 1, 1, 1 FROM (SELECT unnest(list_transform(list_zip(l, w), lambda z: {'a': z[1], 'b': z[2]})) AS x FROM wt WHERE NOT lexical) WHERE x.b <> ''),
rounded AS (SELECT lhs, rhs, word, n, round(rel, 9) AS rel, round(ewe, 9) AS ewe, round(bon, 9) AS bon, shortest FROM rl)"""

# Fragments that recur, and every production.
_DOUBLE_SQL = _CHAIN_SQL + """,
af AS (SELECT root, p, frag FROM found UNION SELECT root, p[1:1], opens[1] || ends[1] || ')' FROM ch),
oc AS (SELECT root, frag, 1.0::DOUBLE / count(*) OVER (PARTITION BY sentno) AS u FROM af JOIN pre USING (p)),
fr AS (SELECT root, frag, count(*) AS n, sum(u) AS u FROM oc GROUP BY ALL)"""

# All fragments of one and two levels of trees with words: a node's children are open or stand with their production.
_DOP1_SQL = R.factored_sql("balanced", True) + """,
one AS (
  SELECT sentno, nid, parent, side, label, CASE WHEN contains(prod, '=') THEN NULL ELSE string_split(prod, ' ')[2:] END AS over,
    '(' || label || ' ' || CASE WHEN contains(prod, '=') THEN split_part(prod, ' =', 2) ELSE array_to_string(list_transform(string_split(prod, ' ')[2:], lambda x: '(' || x || ' )'), ' ') END || ')' AS frag FROM fnodes),
two AS (
  SELECT a.sentno, a.label AS root, a.frag AS low, a.over, ['(' || a.over[1] || ' )'] || CASE WHEN b.frag IS NULL THEN [] ELSE [b.frag] END AS x, ['(' || a.over[2] || ' )'] || CASE WHEN c.frag IS NULL THEN [] ELSE [c.frag] END AS y
  FROM one a LEFT JOIN one b ON b.sentno = a.sentno AND b.parent = a.nid AND b.side = 1 LEFT JOIN one c ON c.sentno = a.sentno AND c.parent = a.nid AND c.side = 2),
occ AS (
  SELECT sentno, root, low AS frag FROM two WHERE over IS NULL
  UNION ALL SELECT sentno, root, '(' || root || ' ' || unnest(x) || ')' FROM two WHERE len(over) = 1
  UNION ALL SELECT sentno, root, '(' || root || ' ' || x1 || ' ' || unnest(y) || ')' FROM (SELECT *, unnest(x) AS x1 FROM two WHERE len(over) = 2)),
fr AS (SELECT root, frag, count(*) AS n, sum(u) AS u FROM (SELECT root, frag, 1.0::DOUBLE / count(*) OVER (PARTITION BY sentno) AS u FROM occ) GROUP BY ALL)"""


def _dop_rules(nodes, counted, seen=None):
    out = dop.rules(dop.flattened(counted), nodes, seen).withColumn("rhs", F.array_join("rhs", " "))
    return out.withColumns({c: F.round(c, 9) for c in ("rel", "ewe", "bon")})


def _dop_back(nodes, counted, seen=None):
    flat = dop.flattened(counted)
    return dop.restored(dop.rules(flat, nodes, seen), dop.dictionary(flat))


@query("dop_double", f"WITH RECURSIVE {_DOUBLE_SQL}, {_FLAT_SQL} SELECT * FROM rounded")
def dop_double(spark, sf_dir):
    nodes = staged(R.factored_nodes(spark, sf_dir, "right"))
    return _dop_rules(nodes, dop.double_dop(nodes))


@query("dop_double_back", f"WITH RECURSIVE {_DOUBLE_SQL} SELECT frag, n FROM fr")
def dop_double_back(spark, sf_dir):
    nodes = staged(R.factored_nodes(spark, sf_dir, "right"))
    return _dop_back(nodes, dop.double_dop(nodes))


@query("dop_one", f"WITH RECURSIVE {_DOP1_SQL}, {_FLAT_SQL} SELECT * FROM rounded")
def dop_one(spark, sf_dir):
    nodes = R.factored_nodes(spark, sf_dir, "balanced", words=True)
    return _dop_rules(nodes, *dop.dop1_seen(nodes, 2))


@query("dop_one_back", f"WITH RECURSIVE {_DOP1_SQL} SELECT frag, n FROM fr")
def dop_one_back(spark, sf_dir):
    nodes = R.factored_nodes(spark, sf_dir, "balanced", words=True)
    return _dop_back(nodes, *dop.dop1_seen(nodes, 2))


# --- evaluation ---

_PAIRS_SQL = R.BRACKETS_SQL + ", pr AS (SELECT sentno, label, leaves, coalesce(g, 0) AS g, coalesce(c, 0) AS c FROM (SELECT *, 1 AS g FROM gold) FULL JOIN (SELECT *, 1 AS c FROM cand) USING (sentno, label, leaves))"
_SUMS = "sum(least(g, c))::BIGINT AS matching, sum(g)::BIGINT AS gold, sum(c)::BIGINT AS candidate"
_PRF = "matching, gold, candidate, round(matching / candidate, 9) AS precision, round(matching / gold, 9) AS recall, round(2.0 * (matching / candidate) * (matching / gold) / (matching / candidate + matching / gold), 9) AS f"


def _pairs(spark, sf_dir):
    return evaluate.paired(*R.gold_and_candidate(spark, sf_dir))


@query("eval_summary", f"WITH {_PAIRS_SQL} SELECT {_PRF} FROM (SELECT {_SUMS} FROM pr)")
def eval_summary(spark, sf_dir):
    return evaluate.summary(_pairs(spark, sf_dir))


@query("eval_by_label", f"WITH {_PAIRS_SQL} SELECT label, {_PRF} FROM (SELECT label, {_SUMS} FROM pr GROUP BY label)")
def eval_by_label(spark, sf_dir):
    return evaluate.summary(_pairs(spark, sf_dir), "label")


@query("eval_discontinuous", f"WITH {_PAIRS_SQL} SELECT {_PRF} FROM (SELECT {_SUMS} FROM pr WHERE leaves[len(leaves)] - leaves[1] + 1 > len(leaves))")
def eval_discontinuous(spark, sf_dir):
    return evaluate.summary(evaluate.discontinuous(_pairs(spark, sf_dir)))


@query("eval_exact", f"""WITH {_PAIRS_SQL} SELECT count(*) AS sentences, sum((sentno IN (SELECT sentno FROM cand))::INT)::BIGINT AS parsed, sum(same::INT)::BIGINT AS exact
FROM (SELECT sentno, bool_and(g = c) AS same FROM pr WHERE sentno IN (SELECT sentno FROM gold) GROUP BY sentno)""")
def eval_exact(spark, sf_dir):
    g, c = R.gold_and_candidate(spark, sf_dir)
    return evaluate.exact(evaluate.paired(g, c))


@query("eval_confusions", f"WITH {_PAIRS_SQL} SELECT g.label AS gold, c.label AS candidate, count(*) AS n FROM gold g JOIN cand c ON g.sentno = c.sentno AND g.leaves = c.leaves AND g.label <> c.label GROUP BY ALL ORDER BY n DESC, gold, candidate LIMIT 10")
def eval_confusions(spark, sf_dir):
    return evaluate.confusions(*R.gold_and_candidate(spark, sf_dir))


@query("eval_tag_accuracy", f"WITH {R.TOKENS_SQL} SELECT count(*) AS n, sum((tag = CASE WHEN length(word) > 3 THEN tag ELSE 'LOW' END)::INT)::BIGINT AS \"right\", round(sum((tag = CASE WHEN length(word) > 3 THEN tag ELSE 'LOW' END)::INT) / count(*), 9) AS accuracy FROM tokens")
def eval_tag_accuracy(spark, sf_dir):
    t = R.tokens(spark, sf_dir).select(F.struct("doc_id", "lineno").alias("sentno"), "pos", "word", "tag")
    other = t.select("sentno", "pos", F.when(F.length("word") > 3, F.col("tag")).otherwise("LOW").alias("tag"))
    return evaluate.tag_accuracy(t.select("sentno", "pos", "tag"), other)


# Trees halved against trees factored to the right, some words tagged otherwise, some sentences left out.
PARAMS = """
# what to remove and what is equal
DELETE_LABEL NF
DELETE_LABEL ORD-F|<RF,RF>
DELETE_WORD w7
DELETE_LABEL_FOR_LENGTH NF
EQ_LABEL ORD-F|<RF,AF> ORD-F|<AF,RF>
EQ_LABEL ORD-F|<AF,RF> ORD-F|<AF,AF>
CUTOFF_LEN 4
"""
_RIGHT_SQL = R.factored_sql("right", True)[len(R.ITEMS_SQL):].replace("fnodes", "gnodes").replace("every", "gevery").replace("spans", "gspans").replace("sents", "gsents")
_PARAM_SQL = "WITH RECURSIVE " + R.factored_sql("balanced", True) + _RIGHT_SQL + """,
tk AS (
  SELECT *, CASE WHEN stay THEN sum(stay::INT) OVER (PARTITION BY sentno ORDER BY ix) - 1 END AS new
  FROM (SELECT corpus, sentno, ix, label, word, label <> 'NF' AND word <> 'w7' AS stay, CASE WHEN word IN ('w8', 'w9') THEN 'XX' ELSE label END AS other FROM items)),
ph AS (
  SELECT 'g' AS kind, corpus, sentno, a, b, top, root, labels FROM every UNION ALL SELECT 'c', corpus, sentno, a, b, top, root, labels FROM gevery WHERE sentno % 97 <> 0),
pl AS (
  SELECT kind, corpus, sentno, a, b, CASE WHEN top THEN root WHEN root = 'ORD-F' AND labels[a] || labels[b] IN ('RFAF', 'AFRF', 'AFAF') THEN 'ORD-F|<AF,AF>' ELSE root || '|<' || labels[a] || ',' || labels[b] || '>' END AS label FROM ph WHERE top OR a < b),
pb AS (
  SELECT kind, pl.corpus, pl.sentno, pl.label, list(new ORDER BY new) AS leaves FROM pl JOIN tk ON tk.sentno = pl.sentno AND tk.ix BETWEEN a AND b AND tk.stay WHERE pl.label <> 'ORD-F|<RF,RF>' GROUP BY kind, pl.corpus, pl.sentno, pl.label, a, b),
pp AS (SELECT corpus, sentno, label, leaves, count(*) FILTER (kind = 'g') AS g, count(*) FILTER (kind = 'c') AS c FROM pb GROUP BY ALL),
ps AS (SELECT sentno, sum(least(g, c))::BIGINT AS matching, sum(g)::BIGINT AS gold, sum(c)::BIGINT AS candidate, bool_and(g = c) AS same FROM pp GROUP BY sentno),
pw AS (
  SELECT corpus, sentno, count(*) FILTER (label <> 'NF') AS length, count(new) AS words, sentno % 97 <> 0 AS parsed, sentno % 97 <> 0 AS same_words, CASE WHEN sentno % 97 <> 0 THEN count(*) FILTER (stay AND label = other) ELSE 0 END AS tags_right FROM tk GROUP BY corpus, sentno),
pf AS (
  SELECT corpus, sentno, length, words, parsed, same_words, coalesce(matching, 0) AS matching, coalesce(gold, 0) AS gold, coalesce(candidate, 0) AS candidate, parsed AND coalesce(same, true) AS exact, tags_right FROM pw LEFT JOIN ps USING (sentno)),
pr2 AS (SELECT *, CASE WHEN candidate > 0 THEN matching / candidate END AS p, CASE WHEN gold > 0 THEN matching / gold END AS r FROM pf),
pe AS (
  SELECT corpus, sentno, length, words, parsed, same_words, matching, gold, candidate, round(p, 9) AS precision, round(r, 9) AS recall, CASE WHEN p > 0 AND r > 0 THEN round(2 * p * r / (p + r), 9) END AS f, exact, tags_right FROM pr2)
"""


def _param_sentences(spark, sf_dir):
    gold, other = R.spelled_nodes(spark, sf_dir), R.spelled_nodes(spark, sf_dir, "right").where("sentno % 97 != 0")
    other = other.withColumn("label", F.when(F.col("word").isin("w8", "w9"), "XX").otherwise(F.col("label")))
    return evaluate.by_sentence(gold, other, evaluate.parameters(PARAMS))


@query("eval_by_sentence", _PARAM_SQL + "SELECT * FROM pe")
def eval_by_sentence(spark, sf_dir):
    return _param_sentences(spark, sf_dir)


@query("eval_parameters", _PARAM_SQL + """, sc AS (SELECT *, unnest(CASE WHEN length <= 4 THEN ['all', 'cutoff'] ELSE ['all'] END) AS scope FROM pe),
su AS (SELECT scope, count(*) AS sentences, count(*) FILTER (parsed) AS parsed, count(*) FILTER (exact) AS exact, sum(matching)::BIGINT AS matching, sum(gold)::BIGINT AS gold, sum(candidate)::BIGINT AS candidate, round(avg(f), 9) AS mean_f, round(sum(tags_right) / sum(words), 9) AS tag_accuracy FROM sc GROUP BY scope)
SELECT scope, sentences, parsed, exact, matching, gold, candidate, round(matching / candidate, 9) AS precision, round(matching / gold, 9) AS recall, round(2.0 * (matching / candidate) * (matching / gold) / (matching / candidate + matching / gold), 9) AS f, mean_f, tag_accuracy FROM su""")
def eval_parameters(spark, sf_dir):
    return evaluate.totals(_param_sentences(spark, sf_dir), evaluate.parameters(PARAMS))


# --- derivations ---

_DERIV_SQL = "d AS (SELECT l_orderkey AS sent, l_returnflag || l_linestatus AS tree, l_quantity AS nfrags, l_extendedprice / 10000 AS cost FROM lineitem)"


def _derivations(spark, sf_dir):
    return R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sent"), F.concat("l_returnflag", "l_linestatus").alias("tree"), F.col("l_quantity").alias("nfrags"), (F.col("l_extendedprice") / 10000).alias("cost"))


@query("rank_mpd", f"WITH {_DERIV_SQL} SELECT sent, arg_min(tree, (cost, tree)) AS tree, min(cost) AS cost FROM d GROUP BY sent")
def rank_mpd(spark, sf_dir):
    return ranking.most_probable_derivation(_derivations(spark, sf_dir))


_MASS_SQL = _DERIV_SQL + ", l AS (SELECT *, min(cost) OVER (PARTITION BY sent) AS low FROM d), m AS (SELECT sent, tree, sum(exp(low - cost)) AS mass, any_value(low) AS low, min((nfrags, cost)) AS b FROM l GROUP BY sent, tree)"


@query("rank_mpp", f"WITH {_MASS_SQL} SELECT sent, arg_max(tree, (round(mass, 12), tree)) AS tree, round(arg_max(low - ln(mass), (round(mass, 12), tree)), 9) AS cost FROM m GROUP BY sent")
def rank_mpp(spark, sf_dir):
    return ranking.most_probable_parse(_derivations(spark, sf_dir)).withColumn("cost", F.round("cost", 9))


@query("rank_shortest", f"WITH {_DERIV_SQL} SELECT sent, arg_min(tree, (nfrags, cost, tree)) AS tree, arg_min(nfrags, (nfrags, cost, tree)) AS nfrags, arg_min(cost, (nfrags, cost, tree)) AS cost FROM d GROUP BY sent")
def rank_shortest(spark, sf_dir):
    return ranking.shortest_derivation(_derivations(spark, sf_dir))


@query("rank_k_best", f"WITH {_DERIV_SQL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent ORDER BY cost, nfrags, tree) AS rank FROM d) WHERE rank <= 3")
def rank_k_best(spark, sf_dir):
    return ranking.k_best(_derivations(spark, sf_dir), 3)


@query("rank_sl_dop", f"WITH {_MASS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY sent ORDER BY round(mass, 12) DESC, tree) AS r FROM m) SELECT sent, arg_min(tree, (b, tree)) AS tree, arg_min(b[1], (b, tree)) AS nfrags FROM t WHERE r <= 2 GROUP BY sent")
def rank_sl_dop(spark, sf_dir):
    return ranking.sl_dop(_derivations(spark, sf_dir), 2)


def _constituents_sql(longest: int = 24) -> str:
    """A table for each span length up to the longest that the orders may have."""
    levels = ["""d1 AS MATERIALIZED (SELECT sent, s, e, q AS score, [{'label': label, 's': s, 'e': e}] AS tree FROM sp WHERE e - s = 1)"""]
    for n in range(2, longest + 1):
        levels.append(f"""b{n} AS MATERIALIZED (
  SELECT p.sent, p.s, p.e, p.label, p.q, max({{'sum': round(l.score + r.score, 9), 'mid': l.e}}) AS b FROM sp p JOIN d{n - 1} l ON l.sent = p.sent AND l.s = p.s JOIN d{n - 1} r ON r.sent = p.sent AND r.s = l.e AND r.e = p.e WHERE p.e - p.s = {n} GROUP BY ALL),
d{n} AS MATERIALIZED (SELECT * FROM d{n - 1} UNION ALL SELECT b.sent, b.s, b.e, q + b.b.sum, list_concat([{{'label': label, 's': b.s, 'e': b.e}}], list_concat(l.tree, r.tree)) FROM b{n} b JOIN d{n - 1} l ON l.sent = b.sent AND l.s = b.s AND l.e = b.b.mid JOIN d{n - 1} r ON r.sent = b.sent AND r.s = b.b.mid AND r.e = b.e)""")
    return f"""WITH {R.ITEMS_SQL},
k AS (SELECT sentno AS sent, root, label AS item, ix AS k, nsib AS n, (nsib + 1) // 2 AS h FROM items),
an AS (
  SELECT sent, root, item, unnest([1, 2, 3]) AS d, k - 1 AS s, k AS e FROM k UNION ALL SELECT sent, root, item, 1, k - 1, n FROM k WHERE k < n UNION ALL SELECT sent, root, item, 2, 0, k FROM k WHERE k > 1
  UNION ALL SELECT sent, root, item, 3, k - 1, h FROM k WHERE k < h UNION ALL SELECT sent, root, item, 3, k - 1, n FROM k WHERE k > h AND k < n UNION ALL SELECT sent, root, item, 3, 0, n FROM k WHERE k = 1 AND n > h),
br AS (SELECT sent, d, s, e, CASE WHEN e - s = 1 THEN item WHEN d = 2 THEN root || 'L' ELSE root || ((e - s) % 3)::VARCHAR END AS label, 1 + CASE d WHEN 1 THEN sent % 3 / 2 WHEN 2 THEN sent % 5 / 4 ELSE sent % 7 / 6 END AS cost FROM an),
w AS (SELECT sent, d, exp(min(min(cost)) OVER (PARTITION BY sent) - min(cost)) AS w FROM br GROUP BY sent, d),
tt AS (SELECT sent, sum(w) AS total FROM w GROUP BY sent),
q AS (SELECT br.sent, s, e, label, round(sum(w) / any_value(total), 12) AS q FROM br JOIN w ON w.sent = br.sent AND w.d = br.d JOIN tt ON tt.sent = br.sent GROUP BY ALL),
sp AS MATERIALIZED (SELECT sent, s, e, arg_max(label, (q, label)) AS label, max(q) AS q FROM q GROUP BY sent, s, e),
{",".join(levels)}
SELECT sent, score, t.label, t.s::INT AS s, t.e::INT AS e FROM (SELECT sent, round(score, 9) AS score, unnest(tree) AS t FROM d{longest} JOIN (SELECT sent, 0 AS s, max(e) AS e FROM sp GROUP BY sent) USING (sent, s, e))"""


@query("rank_max_constituents", _constituents_sql())
def rank_max_constituents(spark, sf_dir):
    return ranking.max_constituents(R.analyses(spark, sf_dir))


@query("rank_beam", f"WITH {_DERIV_SQL} SELECT sent, tree, nfrags, cost FROM (SELECT *, min(cost) OVER (PARTITION BY sent) AS low FROM d) WHERE cost <= low + 1.5")
def rank_beam(spark, sf_dir):
    return ranking.beam(_derivations(spark, sf_dir), ["sent"], 1.5)


@query("rank_rerank", f"WITH {_DERIV_SQL}, k AS (SELECT DISTINCT sent, tree FROM (SELECT *, row_number() OVER (PARTITION BY sent ORDER BY cost, nfrags, tree) AS rank FROM d) WHERE rank <= 3), s AS (SELECT sent, tree, sum(nfrags) AS cost2 FROM d GROUP BY ALL) SELECT sent, arg_min(tree, (cost2, tree)) AS tree FROM k JOIN s USING (sent, tree) GROUP BY sent")
def rank_rerank(spark, sf_dir):
    d = _derivations(spark, sf_dir)
    return ranking.rerank(d, d.groupBy("sent", "tree").agg(F.sum("nfrags").alias("cost2")), 3)


# --- transforms ---


@query("xf_parent_annotation", f"WITH {R.NODES_SQL} SELECT a.corpus, CASE WHEN p.label IS NULL OR a.is_word THEN a.label ELSE a.label || '^' || p.label END AS label, count(*) AS n FROM nodes a LEFT JOIN nodes p ON p.sentno = a.sentno AND p.nid = a.parent GROUP BY ALL")
def xf_parent_annotation(spark, sf_dir):
    return transforms.parent_annotation(R.order_nodes(spark, sf_dir)).groupBy("corpus", "label").agg(F.count("*").alias("n"))


@query("xf_split_discontinuous", f"""WITH {R.LEAVES_SQL}, r AS (SELECT *, leaf - row_number() OVER (PARTITION BY sentno, label ORDER BY leaf) AS run FROM leaves),
s AS (SELECT sentno, label, run, list_sort(list(leaf)) AS leaves, row_number() OVER (PARTITION BY sentno, label ORDER BY min(leaf)) - 1 AS part, count(*) OVER (PARTITION BY sentno, label) AS parts FROM r GROUP BY sentno, label, run)
SELECT sentno, CASE WHEN parts > 1 THEN label || '*' || part ELSE label END AS label, array_to_string(leaves, ',') AS leaves FROM s""")
def xf_split_discontinuous(spark, sf_dir):
    return transforms.split_discontinuous(R.user_leaves(spark, sf_dir)).withColumn("leaves", F.array_join("leaves", ","))


@query("xf_merge_discontinuous", f"WITH {R.LEAVES_SQL} SELECT sentno, label, array_to_string(list_sort(list(leaf)), ',') AS leaves FROM leaves GROUP BY ALL")
def xf_merge_discontinuous(spark, sf_dir):
    return transforms.merge_discontinuous(transforms.split_discontinuous(R.user_leaves(spark, sf_dir))).withColumn("leaves", F.array_join("leaves", ","))


@query("xf_fanout_markers", f"""WITH {R.LEAVES_SQL}, r AS (SELECT *, leaf - row_number() OVER (PARTITION BY sentno, label ORDER BY leaf) AS run FROM leaves), f AS (SELECT sentno, label, count(DISTINCT run) AS k FROM r GROUP BY ALL)
SELECT sentno, CASE WHEN k > 1 THEN label || '_' || k ELSE label END AS label FROM f""")
def xf_fanout_markers(spark, sf_dir):
    return transforms.fanout_markers(grammar.fanout(R.user_leaves(spark, sf_dir), ["sentno", "label"]))


@query("xf_remove_words", f"""WITH {R.NODES_SQL}, w AS (SELECT corpus, sentno, nid, word, row_number() OVER (PARTITION BY sentno ORDER BY nid) - 1 AS pos FROM nodes WHERE is_word AND word <> 'w7')
SELECT corpus, sentno, nid, word, pos::INT AS pos FROM w""")
def xf_remove_words(spark, sf_dir):
    return transforms.remove_words(R.order_nodes(spark, sf_dir), F.col("word") == "w7")


@query("xf_prune_empty", f"""WITH {R.NODES_SQL} SELECT corpus, count(*) AS n FROM nodes a WHERE NOT is_word AND EXISTS (SELECT 1 FROM nodes b WHERE b.sentno = a.sentno AND b.is_word AND b.word <> 'w7' AND a.nid < b.nid AND b.nid <= a.last) GROUP BY corpus""")
def xf_prune_empty(spark, sf_dir):
    return transforms.kept_nodes(R.order_nodes(spark, sf_dir), F.col("word") == "w7").groupBy("corpus").agg(F.count("*").alias("n"))


@query("xf_canonical_order", f"""WITH {R.LEAVES_SQL}, f AS (SELECT sentno, label, min(leaf) AS lo FROM leaves GROUP BY ALL)
SELECT l.sentno, l.leaf, row_number() OVER (PARTITION BY l.sentno ORDER BY lo, leaf) - 1 AS new FROM leaves l JOIN f USING (sentno, label)""")
def xf_canonical_order(spark, sf_dir):
    return transforms.canonical_order(R.user_leaves(spark, sf_dir))


@query("xf_heads", f"""WITH {R.NODES_SQL}, k AS (SELECT corpus, sentno, parent, nid, row_number() OVER (PARTITION BY sentno, parent ORDER BY CASE label WHEN 'RF' THEN 1 WHEN 'NO' THEN 2 ELSE 3 END, -ix) AS r FROM nodes WHERE depth = 1)
SELECT corpus, sentno, parent, nid AS head FROM k WHERE r = 1""")
def xf_heads(spark, sf_dir):
    return transforms.heads(R.order_nodes(spark, sf_dir).where("depth = 1"), ["RF", "NO"], from_right=True)


@query("xf_dlevel", f"""WITH {R.NODES_SQL} SELECT corpus, CASE WHEN NOT EXISTS (SELECT 1 FROM nodes b WHERE b.sentno = a.sentno AND b.label = 'NO') THEN 0 WHEN EXISTS (SELECT 1 FROM nodes b WHERE b.sentno = a.sentno AND b.label = 'AF') THEN 2 ELSE 1 END AS level, count(*) AS n FROM nodes a WHERE depth = 0 GROUP BY ALL""")
def xf_dlevel(spark, sf_dir):
    has = lambda x: F.max((F.col("label") == x).cast("int")) == 1
    return transforms.levels(R.order_nodes(spark, sf_dir), [(~has("NO"), 0), (has("AF"), 2)], 1).groupBy("corpus", "level").agg(F.count("*").alias("n"))


# --- trees rewritten ---

HUNG_RULES = """
A left-to-right AO AF
N left-to-right NO NF
R left-to-right RO RF
AF right-to-left I
AO like AF
NF like AF
NO like AF
RF like AF
RO like AF
"""
#: Trees t (corpus, sentno, nid, parent, label, pos, word) with side, depth and pos made anew.
_NUMBERED_SQL = """,
up AS (SELECT sentno, nid, parent AS a, 1 AS far FROM t WHERE parent IS NOT NULL UNION ALL SELECT up.sentno, up.nid, t.parent, far + 1 FROM up JOIN t ON t.sentno = up.sentno AND t.nid = up.a WHERE t.parent IS NOT NULL),
fi AS (SELECT sentno, nid, min(pos) AS first FROM (SELECT sentno, nid, pos FROM t UNION ALL SELECT up.sentno, up.a, t.pos FROM up JOIN t ON t.sentno = up.sentno AND t.nid = up.nid) WHERE pos IS NOT NULL GROUP BY ALL),
de AS (SELECT sentno, nid, max(far) AS depth FROM up GROUP BY ALL)
SELECT t.corpus, t.sentno, t.nid, t.parent, CASE WHEN t.parent IS NOT NULL THEN row_number() OVER (PARTITION BY t.sentno, t.parent ORDER BY fi.first, t.nid) END::INT AS side, coalesce(de.depth, 0)::INT AS depth, t.label,
  CASE WHEN t.pos IS NOT NULL THEN count(t.pos) OVER (PARTITION BY t.sentno ORDER BY t.pos) END::INT AS pos, t.word
FROM t JOIN fi ON fi.sentno = t.sentno AND fi.nid = t.nid LEFT JOIN de ON de.sentno = t.sentno AND de.nid = t.nid"""
_HUNG = f"WITH RECURSIVE {R.HUNG_SQL}"
_T = "SELECT corpus, sentno, nid, parent, label, pos, word FROM hw"


@query("xf_raise", _HUNG + """,
wb AS (SELECT sentno, 0 AS nid, ix AS pos FROM hi UNION ALL SELECT sentno, f, ix FROM hi WHERE NOT off UNION ALL SELECT sentno, l, ix FROM hi WHERE NOT off UNION ALL SELECT sentno, ix + 100, ix FROM hi),
he AS (
  SELECT sentno, 0 AS nid, 1 AS word FROM hi WHERE ix = 1 UNION ALL SELECT sentno, f, coalesce(max(ix) FILTER (label LIKE '%O'), max(ix)) FROM hi WHERE NOT off GROUP BY sentno, f
  UNION ALL SELECT sentno, l, max(ix) FROM hi WHERE NOT off GROUP BY sentno, l UNION ALL SELECT sentno, ix + 100, ix FROM hi),
ru AS (SELECT sentno, nid, min(pos) AS lo, max(pos) AS hi FROM (SELECT *, pos - row_number() OVER (PARTITION BY sentno, nid ORDER BY pos) AS run FROM wb) GROUP BY sentno, nid, run),
ow AS (SELECT ru.sentno, ru.nid, lo, hi FROM ru JOIN he ON he.sentno = ru.sentno AND he.nid = ru.nid AND word BETWEEN lo AND hi),
t AS (
  SELECT n.corpus, n.sentno, n.nid, CASE WHEN n.nid = 0 THEN NULL WHEN b.lo <= a.lo AND a.hi <= b.hi THEN n.parent WHEN c.lo <= a.lo AND a.hi <= c.hi THEN p.parent ELSE 0 END AS parent, n.label, n.pos, n.word
  FROM hw n JOIN ow a ON a.sentno = n.sentno AND a.nid = n.nid LEFT JOIN ow b ON b.sentno = n.sentno AND b.nid = n.parent
  LEFT JOIN hw p ON p.sentno = n.sentno AND p.nid = n.parent LEFT JOIN ow c ON c.sentno = n.sentno AND c.nid = p.parent)""" + _NUMBERED_SQL)
def xf_raise(spark, sf_dir):
    return rewrite.raised_by(R.hung_nodes(spark, sf_dir), HUNG_RULES)


@query("xf_punct_move", _HUNG + f""",
nx AS (SELECT a.sentno, a.ix, min(b.ix) AS w FROM hi a JOIN hi b ON b.sentno = a.sentno AND b.ix > a.ix AND NOT b.off WHERE a.off GROUP BY ALL),
be AS (SELECT sentno, ix, f, l, min(ix) OVER (PARTITION BY sentno, f) AS f0, min(ix) OVER (PARTITION BY sentno, l) AS l0 FROM hi WHERE NOT off),
mv AS (SELECT nx.sentno, nx.ix + 100 AS nid, CASE WHEN f0 = w THEN 0 WHEN l0 = w THEN f ELSE l END AS dest FROM nx JOIN be ON be.sentno = nx.sentno AND be.ix = nx.w),
t AS (SELECT hw.corpus, hw.sentno, hw.nid, coalesce(dest, parent) AS parent, label, pos, word FROM hw LEFT JOIN mv ON mv.sentno = hw.sentno AND mv.nid = hw.nid)""" + _NUMBERED_SQL)
def xf_punct_move(spark, sf_dir):
    return rewrite.punct_moved(R.hung_nodes(spark, sf_dir))


@query("xf_punct_root", f"{_HUNG}, t AS ({_T})" + _NUMBERED_SQL)
def xf_punct_root(spark, sf_dir):
    """Moved and moved back: the trees as they were."""
    return rewrite.rewritten(R.hung_nodes(spark, sf_dir), rewrite.move, rewrite.to_root, mark=rewrite.is_punct())


@query("xf_punct_remove", f"{_HUNG}, t AS ({_T} WHERE label <> '$,')" + _NUMBERED_SQL)
def xf_punct_remove(spark, sf_dir):
    return rewrite.punct_removed(R.hung_nodes(spark, sf_dir))


@query("xf_punct_prune", f"""{_HUNG}, en AS (SELECT sentno, min(ix) AS a, max(ix) AS b FROM hi WHERE NOT off GROUP BY sentno),
t AS (SELECT corpus, hw.sentno, nid, parent, label, pos, word FROM hw JOIN en ON en.sentno = hw.sentno WHERE pos IS NULL OR pos BETWEEN a AND b)""" + _NUMBERED_SQL)
def xf_punct_prune(spark, sf_dir):
    return rewrite.punct_pruned(R.hung_nodes(spark, sf_dir), R.HUNG)


# --- heads and dependencies ---

HEAD_RULES = """
% label direction heads
ORD-O right-to-left NO ORD-O
ORD-F left-to-right RF AF
ORD-F rightdis ORD-F NF
ORD-P like ORD-F
"""
FLAT_RULES = """
ORD-O right-to-left NO
ORD-F left-to-right RF AF
ORD-P rightdis RF NO
"""
MODIFIERS = """
ORD NF
* RF-SB AF-*
"""
_CUT = r"\|<.*"

_HEADS_SQL = "WITH RECURSIVE " + R.factored_sql("balanced", True) + r""",
hn AS (
  SELECT corpus, sentno, nid, parent, side, depth, label, CASE WHEN label = 'AF' AND side = 2 THEN 'MO-HD' WHEN side = 1 THEN 'SB' ELSE '--' END AS func,
    CASE WHEN contains(prod, ' =') THEN sum(contains(prod, ' =')::INT) OVER (PARTITION BY sentno ORDER BY nid) END::INT AS pos, regexp_replace(label, '\|<.*', '') AS cl, split_part(prod, ' =', 2) AS word FROM fnodes),
sc AS (
  SELECT k.corpus, k.sentno, k.parent, k.nid, CASE WHEN k.func = 'MO-HD' THEN [0, k.side, 0, 0] ELSE [2, 0, k.side, 0] END AS c, CASE WHEN k.func = 'MO-HD' THEN [0, k.side, 0, 0]
    WHEN p.cl = 'ORD-O' AND k.cl = 'NO' THEN [1, 0, 0, -k.side] WHEN p.cl = 'ORD-O' AND k.cl = 'ORD-O' THEN [1, 0, 1, -k.side]
    WHEN p.cl <> 'ORD-O' AND k.cl = 'RF' THEN [1, 0, 0, k.side] WHEN p.cl <> 'ORD-O' AND k.cl = 'AF' THEN [1, 0, 1, k.side]
    WHEN p.cl <> 'ORD-O' AND k.cl = 'ORD-F' THEN [1, 1, -k.side, 0] WHEN p.cl <> 'ORD-O' AND k.cl = 'NF' THEN [1, 1, -k.side, 1] ELSE [2, (k.label = 'NF')::INT, -k.side, 0] END AS s
  FROM hn k JOIN hn p ON p.sentno = k.sentno AND p.nid = k.parent),
hd AS (SELECT corpus, sentno, parent AS nid, arg_min(nid, s) AS head, arg_min(nid, c) AS other FROM sc GROUP BY ALL),
lx AS (SELECT corpus, sentno, nid, pos AS word FROM hn WHERE pos IS NOT NULL UNION ALL SELECT hd.corpus, hd.sentno, hd.nid, lx.word FROM lx JOIN hd ON hd.sentno = lx.sentno AND hd.head = lx.nid),
lo AS (SELECT corpus, sentno, nid, pos AS word FROM hn WHERE pos IS NOT NULL UNION ALL SELECT hd.corpus, hd.sentno, hd.nid, lo.word FROM lo JOIN hd ON hd.sentno = lo.sentno AND hd.other = lo.nid),
ar AS (
  SELECT n.corpus, n.sentno, c.word AS dep, CASE WHEN n.parent IS NULL THEN 0 ELSE p.word END AS head, CASE WHEN n.parent IS NULL THEN 'root' WHEN n.func = '--' THEN '-' ELSE n.func END AS rel
  FROM hn n JOIN lx c ON c.sentno = n.sentno AND c.nid = n.nid LEFT JOIN lx p ON p.sentno = n.sentno AND p.nid = n.parent LEFT JOIN hd h ON h.sentno = n.sentno AND h.nid = n.parent WHERE n.parent IS NULL OR h.head <> n.nid),
br AS (
  SELECT n.corpus, n.sentno, c.word AS dep, CASE WHEN n.parent IS NULL THEN 0 ELSE p.word END AS head, CASE WHEN n.parent IS NULL THEN 'root' WHEN n.func = '--' THEN '-' ELSE n.func END AS rel
  FROM hn n JOIN lo c ON c.sentno = n.sentno AND c.nid = n.nid LEFT JOIN lo p ON p.sentno = n.sentno AND p.nid = n.parent LEFT JOIN hd h ON h.sentno = n.sentno AND h.nid = n.parent WHERE n.parent IS NULL OR h.other <> n.nid)
"""


def _head_children(nodes):
    return heads.head_children(nodes, HEAD_RULES, punct=("NF",), cut=_CUT)


def _arcs(nodes):
    return heads.arcs(nodes, staged(_head_children(nodes)), virtual_root=False)


def _headed(spark, sf_dir):
    """Written once: heads, pointers and arcs read them again and again."""
    return staged(R.headed_nodes(spark, sf_dir))


def _words(spark, sf_dir):
    return R.order_items(spark, sf_dir).select("corpus", "sentno", F.col("ix").alias("pos"), "word", F.col("label").alias("tag"))


@query("head_children", _HEADS_SQL + "SELECT corpus, sentno, nid, head FROM hd")
def head_children(spark, sf_dir):
    return _head_children(_headed(spark, sf_dir))


@query("head_lexical", _HEADS_SQL + "SELECT corpus, sentno, nid, word FROM lx")
def head_lexical(spark, sf_dir):
    nodes = _headed(spark, sf_dir)
    return heads.lexical_heads(nodes, _head_children(nodes))


_FLAT_HEADS_SQL = f"WITH {R.NODES_SQL}" + """,
fk AS (SELECT k.corpus, k.sentno, k.nid, k.ix AS side, k.nsib, k.label, p.label AS lhs FROM nodes k JOIN nodes p ON p.sentno = k.sentno AND p.depth = 0 WHERE k.depth = 1),
fs AS (
  SELECT *, CASE WHEN lhs = 'ORD-O' AND label = 'NO' THEN [1, 0, 0, -side] WHEN lhs = 'ORD-F' AND label = 'RF' THEN [1, 0, 0, side] WHEN lhs = 'ORD-F' AND label = 'AF' THEN [1, 0, 1, side]
    WHEN lhs = 'ORD-P' AND label = 'RF' THEN [1, 0, -side, 0] WHEN lhs = 'ORD-P' AND label = 'NO' THEN [1, 0, -side, 1] ELSE [2, (label = 'NF')::INT, CASE WHEN lhs = 'ORD-F' THEN side ELSE -side END, 0] END AS s FROM fk),
fb AS (SELECT corpus, sentno, arg_min(side, s) AS place, min(s)[1] AS kind FROM fs GROUP BY ALL),
fh AS (
  SELECT corpus, sentno, CASE WHEN kind = 1 AND (SELECT any_value(label) FROM fk WHERE fk.sentno = fb.sentno AND side = place - 1) = 'AF' THEN coalesce((SELECT max(side) FROM fk WHERE fk.sentno = fb.sentno AND side <= place - 2 AND label <> 'NF'), place) ELSE place END AS place FROM fb)
"""


def _flat_heads(nodes):
    return heads.head_children(nodes, FLAT_RULES, punct=("NF",), conj=("AF",))


@query("head_coordinated", _FLAT_HEADS_SQL + "SELECT corpus, sentno, 0 AS nid, 2 * place - 1 AS head FROM fh")
def head_coordinated(spark, sf_dir):
    return _flat_heads(R.flat_nodes(spark, sf_dir))


@query("head_kinds", _FLAT_HEADS_SQL + """, kd AS (
  SELECT fk.*, fk.side = fh.place AS is_head, lag(label) OVER (PARTITION BY fk.sentno, fk.side = fh.place ORDER BY fk.side) AS before FROM fk JOIN fh USING (corpus, sentno))
SELECT corpus, sentno, nid, CASE WHEN is_head THEN 'head' WHEN coalesce(before = label, false) OR label IN ('NF', 'AF') OR (label = 'RF' AND side = 1) THEN 'modifier' ELSE 'complement' END AS kind FROM kd""")
def head_kinds(spark, sf_dir):
    nodes = staged(R.flat_nodes(spark, sf_dir))  # read three times
    return heads.kinds(nodes, _flat_heads(nodes), MODIFIERS).select("corpus", "sentno", "nid", "kind")


@query("dep_arcs", _HEADS_SQL + "SELECT * FROM ar")
def dep_arcs(spark, sf_dir):
    return _arcs(_headed(spark, sf_dir))


@query("dep_length", _HEADS_SQL + "SELECT corpus, sum(abs(dep - head))::BIGINT AS length, count(*) AS arcs FROM ar WHERE head <> 0 GROUP BY corpus")
def dep_length(spark, sf_dir):
    return heads.dependency_length(_arcs(_headed(spark, sf_dir)), ["corpus"])


@query("dep_scores", _HEADS_SQL + """SELECT corpus, count(*) AS gold, count(*) AS candidate, count(*) FILTER (a.head = b.head) AS heads, count(*) FILTER (a.head = b.head AND a.rel = b.rel) AS arcs,
  count(*) FILTER (a.head = b.head) / count(*) AS unlabelled, count(*) FILTER (a.head = b.head AND a.rel = b.rel) / count(*) AS labelled FROM ar a JOIN br b USING (corpus, sentno, dep) GROUP BY corpus""")
def dep_scores(spark, sf_dir):
    """Arcs by the rules against arcs by the first child."""
    return heads.scored(R.headed_nodes(spark, sf_dir), heads.Rules(HEAD_RULES, punct=("NF",), cut=_CUT), heads.Rules("", cut=_CUT), ["corpus"])


@query("dep_conll", _HEADS_SQL + """SELECT corpus, sentno, string_agg(concat_ws(chr(9), dep, i.word, '_', i.label, i.label, '_', head, rel, '_', '_'), chr(10) ORDER BY dep) || chr(10) || chr(10) AS text
FROM ar JOIN items i USING (corpus, sentno) WHERE i.ix = dep GROUP BY corpus, sentno""")
def dep_conll(spark, sf_dir):
    return heads.conll(_arcs(_headed(spark, sf_dir)), _words(spark, sf_dir))


@query("dep_mst", _HEADS_SQL + """SELECT corpus, sentno, string_agg(i.word, chr(9) ORDER BY dep) || chr(10) || string_agg(i.label, chr(9) ORDER BY dep) || chr(10) || string_agg(rel, chr(9) ORDER BY dep) || chr(10) || string_agg(head::VARCHAR, chr(9) ORDER BY dep) || chr(10) || chr(10) AS text
FROM ar JOIN items i USING (corpus, sentno) WHERE i.ix = dep GROUP BY corpus, sentno""")
def dep_mst(spark, sf_dir):
    return heads.mst(_arcs(_headed(spark, sf_dir)), _words(spark, sf_dir))
