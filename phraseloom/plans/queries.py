"""The engine's queries on the documents table, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.operators import bounded, grams, miners, sequences, tree
from phraseloom.plans.tables import settle
from phraseloom.sources import corpus as corpora
from phraseloom.sources import exchange, synthetic

N, MIN_DOCS = 4, 3
#: Bounded phrases: least and greatest length, support.
SHORT, LONG, BOUNDED_DOCS = 3, 6, 5
#: Closed phrases by occurrences: least length, and the miner's own default support, whatever the number of documents.
CLOSED_LENGTH, CLOSED_LEAST = 3, 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.with_tokens(documents(spark, sf_dir))


def _stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For miners that read the tokens again each round."""
    return settle(_tokens(spark, sf_dir), "tokens")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table: closed phrases of bounded length by documents."""
    found = bounded.reduced(_tokens(spark, sf_dir), "closed", SHORT, LONG, BOUNDED_DOCS)
    return found.select("phrase", F.col("df").alias("freq"), "length")


def tokens(spark, sf_dir):
    return grams.positions(_tokens(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def doc_stats(spark, sf_dir):
    return grams.doc_stats(_tokens(spark, sf_dir))


def vocab_df(spark, sf_dir):
    return grams.vocabulary(_tokens(spark, sf_dir))


def vocab_frequent(spark, sf_dir):
    return grams.frequent_only(grams.vocabulary(_tokens(spark, sf_dir)), 10)


def ngram_support(spark, sf_dir):
    return grams.support(_tokens(spark, sf_dir), N)


def seeds(spark, sf_dir):
    return grams.seeds(_tokens(spark, sf_dir), N, MIN_DOCS)


def seed_topk(spark, sf_dir):
    return grams.top_seeds(grams.seeds(_tokens(spark, sf_dir), N, MIN_DOCS), 100)


def prefilter_equivalence(spark, sf_dir):
    return grams.seeds(_tokens(spark, sf_dir), N, MIN_DOCS, prefilter=True)


def next_token_support(spark, sf_dir):
    return grams.neighbour_support(_tokens(spark, sf_dir), N, MIN_DOCS, "next")


def prev_token_support(spark, sf_dir):
    return grams.neighbour_support(_tokens(spark, sf_dir), N, MIN_DOCS, "prev")


def best_next_token(spark, sf_dir):
    return grams.best_next(_tokens(spark, sf_dir), N, MIN_DOCS)


def right_closed(spark, sf_dir):
    return grams.one_sided_closed(_tokens(spark, sf_dir), N, MIN_DOCS, "next")


def left_closed(spark, sf_dir):
    return grams.one_sided_closed(_tokens(spark, sf_dir), N, MIN_DOCS, "prev")


def all_frequent_bounded(spark, sf_dir):
    return bounded.all_frequent(_tokens(spark, sf_dir), SHORT, LONG, BOUNDED_DOCS)


def _bounded(rule: str, unit: str = "documents"):
    return lambda spark, sf_dir: bounded.reduced(_tokens(spark, sf_dir), rule, SHORT, LONG, BOUNDED_DOCS, unit)


def gapped_pairs(spark, sf_dir):
    own = _tokens(spark, sf_dir)
    return sequences.gapped_pairs(own, max(2, own.count() // 4))


def gapped_patterns(spark, sf_dir):
    own = _tokens(spark, sf_dir)
    return sequences.gapped_patterns(own, max(2, own.count() // 3), 3)


def _encoded(spark, sf_dir) -> DataFrame:
    """Documents as numbers: here each token's length, so that any engine can say the same."""
    return _tokens(spark, sf_dir).select("doc_id", F.transform("tokens", lambda t: F.length(t)).alias("ids"))


def spmf_export(spark, sf_dir):
    return exchange.sequence_lines(_encoded(spark, sf_dir))


def spmf_import(spark, sf_dir):
    lines = _tokens(spark, sf_dir).select(F.concat(F.size("tokens").cast("string"), F.lit(" -1 "), F.col("doc_id").cast("string"), F.lit(" -1 #SUP: "), (F.col("doc_id") % 7 + 1).cast("string")).alias("value"))
    return exchange.parse_sequence_results(lines, 2).select(F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), "freq", "length")


def result_format(spark, sf_dir):
    found = grams.gram_rows(_tokens(spark, sf_dir), N)
    kept = found.join(grams.support(_tokens(spark, sf_dir), N, 10), "gram").select(F.col("gram").alias("class"), "doc_id", "df")
    names = miners._examples(kept, None).withColumnRenamed("class", "phrase")
    whole = kept.groupBy(F.col("class").alias("phrase")).agg(F.max("df").alias("freq"))
    return exchange.formatted(whole.join(names, "phrase").withColumn("length", F.lit(N)), ellipsis=True)


def result_filter(spark, sf_dir):
    renamed = _results(spark, sf_dir).withColumnsRenamed({"freq": "doc_count", "length": "word_count"})
    return tree.clean_results(renamed, min_length=4, min_freq=6).select("phrase", "freq", "length")


def pareto_score(spark, sf_dir):
    return tree.scored(_results(spark, sf_dir)).select("phrase", "freq", "length", F.round("score", 6).alias("score"))


def tree_parent(spark, sf_dir):
    own = tree.parents(settle(tree.numbered(_results(spark, sf_dir)), "phrases"))
    up = own.select(F.col("id").alias("parent_id"), F.col("phrase").alias("parent"))
    return own.join(up, "parent_id", "left").select("phrase", "parent")


def tree_level(spark, sf_dir):
    return tree.build_tree(_results(spark, sf_dir)).select("id", "phrase", "freq", "length", "parent_id", "level")


def top_ancestors(spark, sf_dir):
    return tree.top_with_ancestors(tree.build_tree(_results(spark, sf_dir)), 40).select("id", "phrase", "parent_id", "level", F.round("score", 6).alias("score"))


def tree_display(spark, sf_dir):
    return tree.with_display(tree.build_tree(_results(spark, sf_dir))).select("phrase", "display_phrase")


def hash_sample(spark, sf_dir):
    return sequences.exact_sample(documents(spark, sf_dir), 0.25, 17).select("doc_id")


def mining_stats(spark, sf_dir):
    return sequences.mining_stats(_tokens(spark, sf_dir), N, MIN_DOCS)


def coverage_ratio(spark, sf_dir):
    return sequences.coverage(_tokens(spark, sf_dir), N, MIN_DOCS)


def document_repeats(spark, sf_dir):
    return sequences.top_phrases_by_document(_tokens(spark, sf_dir), N, MIN_DOCS)


def phrases_left_closed(spark, sf_dir):
    return miners.left_closed(_stored_tokens(spark, sf_dir), miners.Params(10, N))


def phrases_default(spark, sf_dir):
    return miners.mine_default(_stored_tokens(spark, sf_dir), miners.Params(10, N))


def phrases_closed(spark, sf_dir):
    return miners.mine_closed(_stored_tokens(spark, sf_dir), miners.Params(CLOSED_LEAST, CLOSED_LENGTH)).select("phrase", "freq", "df", "length")


def phrases_right_closed(spark, sf_dir):
    return miners.mine_closed(_stored_tokens(spark, sf_dir), miners.Params(10, N), unit="documents", left=False).select("phrase", "freq", "length")


def source_table(spark, sf_dir):
    return corpora.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), source_column="source")


def synthetic_recall(spark, sf_dir):
    rules = [("This is the first test sentence", 3), ("Another unique phrase for testing", 5), ("A third sentence", 4)]
    made = synthetic.synthetic_corpus(spark, 1000, 50, rules, seed=3)
    return miners.mine_default(settle(grams.with_tokens(made), "tokens"), miners.Params(3, 3)).select("phrase", "freq", "length")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        tokens, doc_stats, vocab_df, vocab_frequent, ngram_support, seeds, seed_topk, prefilter_equivalence, next_token_support, prev_token_support, best_next_token,
        right_closed, left_closed, all_frequent_bounded, gapped_pairs, gapped_patterns, spmf_export, spmf_import, result_format, result_filter, pareto_score, tree_parent,
        tree_level, top_ancestors, tree_display, hash_sample, mining_stats, coverage_ratio, document_repeats, phrases_left_closed, phrases_default, phrases_closed,
        phrases_right_closed, source_table, synthetic_recall,
    )
    return {f.__name__: f for f in plain} | {
        "closed_occ_bounded": _bounded("closed", "occurrences"),
        "closed_df_bounded": _bounded("closed"),
        "maximal_bounded": _bounded("maximal"),
        "right_maximal_bounded": _bounded("right_maximal"),
        "prefix_closed_bounded": _bounded("right_closed"),
    }


# DuckDB --------------------------------------------------------------------------------------------------------------

TOK = r"""tok AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
p AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tok)"""


def _g(n: int, name: str = "g") -> str:
    joined = " || ' ' || ".join(["token"] + [f"lead(token, {k}) OVER w" for k in range(1, n)])
    return f"""{name} AS (SELECT * FROM (SELECT doc_id, pos, {joined} AS gram, lag(token) OVER w AS prev, lead(token, {n}) OVER w AS next
  FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE gram IS NOT NULL)"""


def _sup(having: str) -> str:
    return f"s AS (SELECT gram, count(DISTINCT doc_id) AS df, count(*) AS occ FROM g GROUP BY gram {having})"


def _frequent_all(unit: str, longest: int) -> str:
    parts = ", ".join(_g(n, f"g{n}") for n in range(SHORT, longest + 1))
    union = " UNION ALL ".join(f"SELECT gram AS phrase, {n} AS length, count(DISTINCT doc_id) AS df, count(*) AS occ FROM g{n} GROUP BY gram" for n in range(SHORT, longest + 1))
    return f"WITH {TOK}, {parts}, a AS (SELECT phrase, length::BIGINT AS length, df, occ FROM ({union}) WHERE {unit} >= {BOUNDED_DOCS})"


def _reduced_sql(rule: str, unit: str = "df") -> str:
    same = f"AND b.{unit} = a.{unit}" if rule.endswith("closed") else ""
    # the one-token extension is found by cutting it, so that the join is by equality
    cuts = [r"regexp_replace(phrase, ' [^ ]*$', '')"] + ([] if rule.startswith("right_") else [r"regexp_replace(phrase, '^[^ ]* ', '')"])
    gone = " AND ".join(f"NOT EXISTS (SELECT 1 FROM (SELECT {c} AS cut, length, df, occ FROM a) b WHERE b.cut = a.phrase AND b.length = a.length + 1 {same})" for c in cuts)
    return f"{_frequent_all(unit, LONG + 1)} SELECT phrase, length, df, occ FROM a WHERE length <= {LONG} AND {gone}"


def _results_sql() -> str:
    return f"r AS (SELECT phrase, df AS freq, length FROM ({_reduced_sql('closed')}))"


TREE = r"""
n AS (SELECT row_number() OVER (ORDER BY length, phrase) - 1 AS id, phrase, freq, length FROM
  (SELECT trim(regexp_replace(lower(phrase), '\s+', ' ', 'g')) AS phrase, freq, length FROM r)),
w AS (SELECT id, string_split(phrase, ' ') AS words FROM n),
d AS (SELECT id, words, unnest(range(1, len(words) - 1)) AS drop FROM w),
k AS (SELECT id, drop, 0 AS kind, array_to_string(words[drop + 1:], ' ') AS cut FROM d
  UNION ALL SELECT id, drop, 1, array_to_string(words[1:len(words) - drop], ' ') FROM d),
f AS (SELECT k.id, arg_min(m.id, drop * 2 + kind) AS parent_id FROM k JOIN n m ON m.phrase = k.cut GROUP BY k.id),
q AS (SELECT n.*, f.parent_id FROM n LEFT JOIN f USING (id)),
l AS (SELECT id, 0::BIGINT AS level FROM q WHERE parent_id IS NULL UNION ALL SELECT q.id, l.level + 1 FROM q JOIN l ON q.parent_id = l.id),
t AS (SELECT q.*, l.level FROM q JOIN l USING (id))"""

SCORE = "sqrt(pow(1 - length / (SELECT max(length) FROM {0}), 2) + pow(1 - ln(1 + freq) / ln(1 + (SELECT max(freq) FROM {0})), 2))"


def _expansion_sql(n: int, least: int) -> str:
    """The greedy expansion, one token a step, and the left rule."""
    return f"""WITH RECURSIVE {TOK}, {_g(n)}, {_sup(f'HAVING count(DISTINCT doc_id) >= {least}')},
e AS (
  SELECT gram AS seed, doc_id, pos, pos + {n} AS stop, prev FROM g WHERE gram IN (SELECT gram FROM s)
  UNION ALL
  SELECT seed, doc_id, pos, stop + 1, prev FROM (
    SELECT x.*, first_value(token) OVER (PARTITION BY seed ORDER BY df DESC, occ DESC, token) AS best FROM (
      SELECT y.*, c.df, c.occ FROM (SELECT e.*, p.token FROM e JOIN p ON p.doc_id = e.doc_id AND p.pos = e.stop) y
      JOIN (SELECT e.seed, p.token, count(DISTINCT e.doc_id) AS df, count(*) AS occ FROM e JOIN p ON p.doc_id = e.doc_id AND p.pos = e.stop
            GROUP BY ALL HAVING count(DISTINCT e.doc_id) >= {least}) c ON c.seed = y.seed AND c.token = y.token) x)
  WHERE token = best),
last AS (SELECT seed, max(stop - pos) AS length FROM e GROUP BY seed),
o AS (SELECT e.* FROM e JOIN last ON e.seed = last.seed AND e.stop - e.pos = last.length),
c AS (SELECT seed, count(DISTINCT doc_id) AS freq, count(*) AS occ, max(stop - pos)::BIGINT AS length, min((doc_id, pos)) AS at FROM o GROUP BY seed
  HAVING NOT (count(prev) = count(*) AND min(prev) = max(prev))),
x AS (SELECT c.*, array_to_string(tok.t[c.at[2] + 1:c.at[2] + c.length], ' ') AS phrase FROM c JOIN tok ON tok.doc_id = c.at[1])
"""


def _selection_sql(n: int, least: int) -> str:
    """Coverage selection one candidate after the other; the list of accepted ranks is the state."""
    return f"""{_expansion_sql(n, least).rstrip()},
v AS (SELECT x.*, s.df AS seed_df, row_number() OVER (ORDER BY s.df DESC, x.seed) AS r FROM x JOIN s ON s.gram = x.seed),
b AS (SELECT v.r, g.doc_id, g.pos FROM g JOIN v ON v.seed = g.gram),
sp AS (SELECT v.r AS by, o.doc_id, o.pos, o.stop FROM o JOIN v ON v.seed = o.seed),
sl AS (SELECT b.r, b.doc_id, b.pos, list(sp.by) FILTER (sp.by IS NOT NULL) AS bys FROM b LEFT JOIN sp
  ON sp.doc_id = b.doc_id AND sp.by < b.r AND sp.pos <= b.pos AND b.pos < sp.stop GROUP BY ALL),
sel AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS accepted
  UNION ALL
  SELECT step + 1, CASE WHEN bool_or(NOT list_has_any(coalesce(bys, []::BIGINT[]), accepted)) THEN list_append(accepted, step + 1) ELSE accepted END
  FROM sel JOIN sl ON sl.r = sel.step + 1 GROUP BY step, accepted),
taken AS (SELECT unnest(accepted) AS r FROM sel WHERE step = (SELECT max(step) FROM sel)),
ex AS (SELECT seed, string_agg(d, '|' ORDER BY d) AS example_files FROM (SELECT seed, d, row_number() OVER (PARTITION BY seed ORDER BY d) AS k
  FROM (SELECT DISTINCT seed, doc_id::VARCHAR AS d FROM o)) WHERE k <= 2 GROUP BY seed)
SELECT phrase, freq, length, example_files, seed, seed_df FROM v JOIN taken USING (r) JOIN ex USING (seed) WHERE length >= {n}"""


def oracle_sql() -> dict[str, str]:
    base, sup = f"WITH {TOK}, {_g(N)}", _sup("")
    often = f"{base}, {_sup(f'HAVING count(DISTINCT doc_id) >= {MIN_DOCS}')}"
    seed = f"{often} SELECT gram, df, occ, {N}::BIGINT AS length, df * {N} AS score FROM s"
    beside = lambda side: f"{often} SELECT gram, {side} AS other, count(DISTINCT doc_id) AS df, count(*) AS occ FROM g JOIN s USING (gram) WHERE {side} IS NOT NULL GROUP BY ALL"
    closed = lambda side: f"{base} SELECT gram, count(DISTINCT doc_id) AS df, count(*) AS occ FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= {MIN_DOCS} AND NOT coalesce(count({side}) = count(*) AND min({side}) = max({side}), false)"
    results, quarter = _results_sql(), "(SELECT greatest(2, count(*) // 4) FROM documents)"
    return {
        "tokens": f"WITH {TOK} SELECT doc_id, pos::BIGINT AS pos, token FROM p",
        "doc_stats": f"WITH {TOK} SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM tok",
        "vocab_df": f"WITH {TOK} SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY token",
        "vocab_frequent": f"WITH {TOK} SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY token HAVING count(DISTINCT doc_id) >= 10",
        "ngram_support": f"{base}, {sup} SELECT * FROM s",
        "seeds": seed,
        "seed_topk": f"{seed} ORDER BY score DESC, gram LIMIT 100",
        "prefilter_equivalence": seed,
        "next_token_support": beside("next"),
        "prev_token_support": beside("prev"),
        "best_next_token": f"SELECT gram, other AS token, df, occ FROM ({beside('next')}) WHERE df >= {MIN_DOCS} QUALIFY row_number() OVER (PARTITION BY gram ORDER BY df DESC, occ DESC, other) = 1",
        "right_closed": closed("next"),
        "left_closed": closed("prev"),
        "all_frequent_bounded": f"{_frequent_all('df', LONG)} SELECT phrase, length, df, occ FROM a",
        "closed_occ_bounded": _reduced_sql("closed", "occ"),
        "closed_df_bounded": _reduced_sql("closed"),
        "maximal_bounded": _reduced_sql("maximal"),
        "right_maximal_bounded": _reduced_sql("right_maximal"),
        "prefix_closed_bounded": _reduced_sql("right_closed"),
        "gapped_pairs": f"""WITH {TOK}, v AS (SELECT token FROM p GROUP BY token HAVING count(DISTINCT doc_id) >= {quarter}),
          h AS (SELECT doc_id, token, min(pos) AS lo, max(pos) AS hi FROM p WHERE token IN (SELECT token FROM v) GROUP BY ALL)
          SELECT a.token AS first, b.token AS second, count(*) AS df FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.lo < b.hi GROUP BY ALL HAVING count(*) >= {quarter}""",
        "spmf_export": f"""WITH {TOK}, y AS (SELECT doc_id, string_agg(length(token) || ' -1 ', '' ORDER BY pos) AS body FROM p GROUP BY doc_id)
          SELECT doc_id, coalesce(body, '') || '-2' AS line FROM tok LEFT JOIN y USING (doc_id)""",
        "spmf_import": f"WITH {TOK} SELECT len(t) || ' ' || doc_id AS ids, doc_id % 7 + 1 AS freq, 2::BIGINT AS length FROM tok",
        "result_format": f"""{base}, e AS (SELECT DISTINCT gram, doc_id::VARCHAR AS d FROM g), x AS (SELECT gram, d, row_number() OVER (PARTITION BY gram ORDER BY d) AS r FROM e),
          y AS (SELECT gram, count(*) AS freq, string_agg(d, '|' ORDER BY d) FILTER (r <= 2) AS names FROM x GROUP BY gram HAVING count(*) >= 10)
          SELECT gram AS phrase, freq, {N}::BIGINT AS length, names || CASE WHEN freq > 2 THEN '...' ELSE '' END AS example_files FROM y""",
        "result_filter": f"WITH {results} SELECT * FROM r WHERE length >= 4 AND freq >= 6",
        "pareto_score": f"WITH {results} SELECT phrase, freq, length, round({SCORE.format('r')}, 6) AS score FROM r",
        "tree_parent": f"WITH RECURSIVE {results}, {TREE} SELECT t.phrase, u.phrase AS parent FROM t LEFT JOIN n u ON u.id = t.parent_id",
        "tree_level": f"WITH RECURSIVE {results}, {TREE} SELECT id, phrase, freq, length, parent_id, level FROM t",
        "top_ancestors": f"""WITH RECURSIVE {results}, {TREE}, z AS (SELECT *, {SCORE.format('t')} AS score FROM t), top AS (SELECT id FROM z ORDER BY score, id LIMIT 40),
          up AS (SELECT id FROM top UNION SELECT z.parent_id FROM z JOIN up ON z.id = up.id WHERE z.parent_id IS NOT NULL)
          SELECT id, phrase, parent_id, level, round(score, 6) AS score FROM z WHERE id IN (SELECT id FROM up)""",
        "tree_display": rf"""WITH RECURSIVE {results}, {TREE} SELECT t.phrase, CASE WHEN u.phrase IS NOT NULL AND contains(t.phrase, u.phrase)
          THEN trim(regexp_replace(replace(t.phrase, u.phrase, ' <PARENT> '), '\s+', ' ', 'g')) ELSE t.phrase END AS display_phrase FROM t LEFT JOIN n u ON u.id = t.parent_id""",
        "hash_sample": "SELECT doc_id FROM documents ORDER BY md5('17:' || doc_id), doc_id LIMIT (SELECT floor(count(*) * 0.25)::BIGINT FROM documents)",
        "mining_stats": f"""{base}, {sup} SELECT coalesce(sum(occ), 0)::BIGINT AS total_ngrams, count(*) AS distinct_ngrams, count(*) FILTER (df >= {MIN_DOCS}) AS accepted,
          round(100.0::DOUBLE * count(*) FILTER (df < {MIN_DOCS}) / greatest(1, count(*)), 4) AS rejected_percent FROM s""",
        "coverage_ratio": f"""{often}, c AS (SELECT doc_id, count(DISTINCT pos + i) AS covered FROM g JOIN s USING (gram), range({N}) r(i) GROUP BY doc_id)
          SELECT doc_id, coalesce(covered, 0) AS covered, len(t)::BIGINT AS n_tokens FROM tok LEFT JOIN c USING (doc_id)""",
        "document_repeats": f"{often} SELECT doc_id, count(DISTINCT gram) AS n_frequent FROM g JOIN s USING (gram) GROUP BY doc_id",
        "phrases_left_closed": f"{_expansion_sql(N, 10)} SELECT seed, s.df AS seed_df, phrase, freq, x.occ, length FROM x JOIN s ON s.gram = x.seed",
        "phrases_default": _selection_sql(N, 10),
        "phrases_right_closed": f"""WITH RECURSIVE {TOK}, {_g(N)},
          e AS (SELECT doc_id, pos, gram, {N} AS n FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) >= 10)
            UNION ALL SELECT doc_id, pos, gram, n FROM (SELECT doc_id, pos, gram, n, count(DISTINCT doc_id) OVER (PARTITION BY gram) AS df FROM (
              SELECT e.doc_id, e.pos, e.gram || ' ' || p.token AS gram, e.n + 1 AS n FROM e JOIN p ON p.doc_id = e.doc_id AND p.pos = e.pos + e.n)) WHERE df >= 10),
          a AS (SELECT gram, n, count(DISTINCT doc_id) AS df FROM e GROUP BY ALL)
          SELECT gram AS phrase, df AS freq, n::BIGINT AS length FROM a WHERE NOT EXISTS (SELECT 1 FROM (SELECT regexp_replace(gram, ' [^ ]*$', '') AS cut, n, df FROM a) b
            WHERE b.cut = a.gram AND b.n = a.n + 1 AND b.df = a.df)""",
        "phrases_closed": f"""WITH RECURSIVE {TOK}, {_g(CLOSED_LENGTH)},
          e AS (SELECT doc_id, pos, gram, {CLOSED_LENGTH} AS n FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(*) >= {CLOSED_LEAST})
            UNION ALL SELECT doc_id, pos, gram, n FROM (SELECT doc_id, pos, gram, n, count(*) OVER (PARTITION BY gram) AS occ FROM (
              SELECT e.doc_id, e.pos, e.gram || ' ' || p.token AS gram, e.n + 1 AS n FROM e JOIN p ON p.doc_id = e.doc_id AND p.pos = e.pos + e.n)) WHERE occ >= {CLOSED_LEAST}),
          b AS (SELECT e.*, x.token AS prev, y.token AS next FROM e LEFT JOIN p x ON x.doc_id = e.doc_id AND x.pos = e.pos - 1 LEFT JOIN p y ON y.doc_id = e.doc_id AND y.pos = e.pos + e.n)
          SELECT gram AS phrase, count(*) AS freq, count(DISTINCT doc_id) AS df, max(n)::BIGINT AS length FROM b GROUP BY gram
          HAVING NOT coalesce(count(prev) = count(*) AND min(prev) = max(prev), false) AND NOT coalesce(count(next) = count(*) AND min(next) = max(next), false)""",
        "source_table": "SELECT doc_id, source, text FROM documents",
        "synthetic_recall": "SELECT * FROM (VALUES ('another unique phrase for testing', 5::BIGINT, 5::BIGINT), ('a third sentence', 4, 3), ('this is the first test sentence', 3, 6)) t(phrase, freq, length)",
    }
