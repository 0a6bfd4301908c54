"""Registered queries: relational analysis, study set-up and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.operators import misassembly as M
from asmlens.operators import relational as R
from asmlens.operators import study as Y
from asmlens.plans.adapters import Tables, duck
from asmlens.plans.analysis import rand
from asmlens.plans.registry import query


def _genomes(t: Tables) -> DataFrame:
    return t.view("genomes")


# --- projections and filters

query("prj1_relocate", 'SELECT p_size AS contigs, p_partkey, p_name, p_brand, p_type FROM part')(lambda t: R.relocate(t["part"], ["p_size"], ("p_retailprice",), {"p_size": "contigs"}))
query("prj2_computed", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size_class, p_retailprice / p_size AS per_size FROM part", "per_size")(
    lambda t: R.computed(t["part"].select("p_partkey", "p_size", "p_retailprice"), size_class=F.when(F.col("p_size") > 25, "large").otherwise("small"), per_size=F.col("p_retailprice") / F.col("p_size")).drop("p_size", "p_retailprice")
)
query("prj3_feature_subset", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")(lambda t: R.feature_subset(t["lineitem"], ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"]))
_RANK_SQL = ", ".join(f"string_split(regexp_replace(taxonomy, '(^|;)[a-z]__', '\\1', 'g'), ';')[{k + 1}] AS \"{r}\"" for k, r in enumerate(R.RANKS))
query("prj4_split_taxonomy", duck(f"SELECT accession, {_RANK_SQL} FROM genomes", "genomes"))(lambda t: R.split_taxonomy(_genomes(t).select("accession", "taxonomy")).drop("taxonomy"))
query("prj5_unite", "SELECT p_partkey, p_brand || '-' || p_type AS label FROM part")(lambda t: R.unite(t["part"], ["p_brand", "p_type"], "label").select("p_partkey", "label"))
query("prj6_separate", "SELECT url_id, string_split(url, '/')[3] AS host, string_split(url, '/')[4] AS folder FROM (SELECT page_id AS url_id, url FROM pages)")(
    lambda t: R.separate(t["pages"].select(F.col("page_id").alias("url_id"), "url"), "url", ["a", "b", "host", "folder"]).select("url_id", "host", "folder")
)
query("fil1_ranges", duck("SELECT accession, contigs, completeness FROM genomes WHERE contigs <= 40 AND completeness >= 920 AND completeness <= 980", "genomes"), "completeness")(
    lambda t: R.within(_genomes(t).select("accession", "contigs", "completeness"), {"contigs": (None, 40), "completeness": (920, 980)})
)
query("fil2_in_set", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")(lambda t: R.in_set(t["orders"], "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey"))
query("fil2_not_in_set", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")(lambda t: R.in_set(t["orders"], "o_orderpriority", ["1-URGENT", "2-HIGH"], True).select("o_orderkey"))
query("fil3_matching", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[L-P][A-Z]+M$')")(lambda t: R.matching(t["part"].select("p_partkey", "p_type"), "p_type", "^[L-P][A-Z]+M$"))
query("fil4_filled", "SELECT event_id FROM events WHERE value IS NOT NULL AND props IS NOT NULL AND props <> ''")(lambda t: R.filled(R.filled(t["events"], "value"), "props").select("event_id"))
query("fil5_size_class", "SELECT doc_id, CASE WHEN n_chars <= 50 THEN 'empty' WHEN n_chars < 1000 THEN 'small' ELSE 'ok' END AS size_class FROM documents")(lambda t: R.size_class(t["documents"].select("doc_id", "n_chars"), "n_chars").select("doc_id", "size_class"))
query("fil6_near_duplicate_hits", duck("SELECT query, hit_len FROM paf WHERE identity >= 0.8 AND query_cov >= 0.5 AND target_cov >= 0.5", "paf"))(lambda t: R.near_duplicate_hits(t.view("paf").withColumn("query_cov", F.when(F.col("query_cov") >= 0.5, 1.0).otherwise(0.0)).withColumn("target_cov", F.when(F.col("target_cov") >= 0.5, 1.0).otherwise(0.0)), 0.8, 0.95).select("query", "hit_len"))
query("fil7_read_quality_gate", duck("SELECT run_id FROM runs WHERE s * 100 >= 1e6 AND s * 100 < 5e7 AND run_id % 200 <= 150 AND run_id % 101 < 90", "runs"))(
    lambda t: R.read_quality_gate(t.view("runs").withColumns({"n_reads": F.col("s") * 100, "read_len": F.col("run_id") % 200, "dedup_percent": F.col("run_id") % 101})).select("run_id")
)

# --- joins

_L, _O = "lineitem l", "orders o"
query("jn1_inner", "SELECT l_orderkey AS k, l_linenumber, l_quantity, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")(
    lambda t: R.join_on(t["lineitem"].select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity"), t["orders"].select("o_orderkey", "o_custkey"), {"k": "o_orderkey"})
)
query("jn2_left", duck("SELECT m.contig, p.score FROM meta m LEFT JOIN preds p ON m.contig = p.contig", "meta", "preds"), "score")(lambda t: R.join_on(t.view("meta").select("contig"), t.view("preds").select("contig", "score"), ["contig"], "left"))
query("jn3_right", duck("SELECT m.contig, p.score FROM preds p RIGHT JOIN meta m ON m.contig = p.contig", "meta", "preds"), "score")(lambda t: R.join_on(t.view("preds").select("contig", "score"), t.view("meta").select("contig"), ["contig"], "right"))
query("jn4_full", "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey")(
    lambda t: R.join_on(t["customer"].where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers")), t["supplier"].groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers")), ["nation"], "full")
)
query("jn5_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")(lambda t: R.join_on(t["customer"].select("c_custkey"), t["orders"].where("o_totalprice > 100000"), {"c_custkey": "o_custkey"}, "left_semi"))
query("jn6_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")(lambda t: R.join_on(t["customer"].select("c_custkey"), t["orders"].where("o_totalprice > 100000"), {"c_custkey": "o_custkey"}, "left_anti"))
query("jn8_grid", "SELECT p_brand, r_name FROM (SELECT DISTINCT p_brand FROM part), region")(lambda t: R.grid(t["part"].select("p_brand").distinct(), t["region"].select("r_name")))
query("jn9_validated_lookup", "SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")(
    lambda t: R.validated_lookup(t["customer"].withColumnRenamed("c_nationkey", "k"), t["nation"].withColumnRenamed("n_nationkey", "k"), "k", "c_acctbal")[0].select("c_custkey", "c_acctbal", "n_name")
)
query("jn9_missing_keys", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 0 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")(
    lambda t: R.validated_lookup(t["customer"].withColumnRenamed("c_nationkey", "k"), t["nation"].where("n_regionkey < 2").withColumnRenamed("n_nationkey", "k"), "k", "c_acctbal")[1]
)
query("jn10_require_overlap", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda t: R.require_overlap(t["supplier"].withColumnRenamed("s_nationkey", "k"), t["nation"].withColumnRenamed("n_nationkey", "k"), "k").select("s_suppkey", "n_name")
)
query("jn11_remap_ids", "SELECT s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) AS id FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON s_nationkey = n_nationkey")(
    lambda t: R.remap_ids(t["supplier"].select("s_suppkey", F.col("s_nationkey").cast("string").alias("id")), t["nation"].where("n_regionkey <> 1").withColumn("n_nationkey", F.col("n_nationkey").cast("string")), "id", "n_nationkey", "n_name")
)

# --- aggregations

query("ag1_group_count", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")(lambda t: R.group_count(t["part"], ["p_brand"]))
query("ag3_distinct_count", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY 1")(lambda t: R.distinct_count(t["orders"], ["o_orderpriority"], "o_custkey"))
query("ag4_first_by", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")(
    lambda t: R.first_by(t["orders"], ["o_custkey"], ["o_orderpriority", "o_orderkey"], ["o_orderkey"])
)
query("ag5_percent_where", duck("SELECT file, 100.0 * sum(CASE WHEN misassembly_cnt > 0 THEN 1.0 ELSE 0 END) / count(*) AS percent FROM meta GROUP BY file", "meta"), "percent")(lambda t: R.percent_where(t.view("meta"), ["file"], F.col("misassembly_cnt") > 0))
query("ag5_percent_bases", duck("SELECT file, 100.0 * sum(CASE WHEN misassembly_cnt > 0 THEN length ELSE 0 END) / sum(length) AS percent FROM meta GROUP BY file", "meta"), "percent")(
    lambda t: R.percent_where(t.view("meta"), ["file"], F.col("misassembly_cnt") > 0, F.col("length"))
)
query("ag6_depth_summary", "SELECT l_suppkey AS contig, avg(d) AS mean, stddev_samp(d) AS sd, count(d) AS n, stddev_samp(d) / sqrt(count(d)) AS stderr, count_if(d = 0) / count(d) AS zero_fraction FROM (SELECT l_suppkey, round(l_discount * 100)::INT AS d FROM lineitem) GROUP BY 1", "mean sd stderr zero_fraction")(
    lambda t: R.depth_summary(t["lineitem"].select(F.col("l_suppkey").alias("contig"), F.round(F.col("l_discount") * 100).cast("int").alias("depth")), ["contig"])
)
query(
    "ag7_five_numbers",
    'SELECT l_returnflag, min(l_extendedprice) AS "min", quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3, max(l_extendedprice) AS "max", avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, stddev_samp(l_extendedprice) / sqrt(count(*)) AS stderr FROM lineitem GROUP BY 1',
    "min q1 median q3 max mean sd stderr",
)(lambda t: R.five_numbers(t["lineitem"], "l_extendedprice", ["l_returnflag"]))
query("ag8_quantiles", "SELECT o_orderstatus, unnest([0, 1, 2])::INT AS k, unnest(quantile_cont(o_totalprice, [0.02, 0.5, 0.98])) AS value FROM orders GROUP BY 1", "value")(lambda t: R.quantiles(t["orders"], "o_totalprice", [0.02, 0.5, 0.98], ["o_orderstatus"]))
query("ag9_frequency_table", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")(lambda t: R.frequency_table(t["lineitem"], ["l_returnflag", "l_linestatus"]))
query(
    "ag10_composition",
    duck("SELECT dataset, genus, sum(p) AS percent FROM (SELECT dataset, CASE WHEN p < 4 THEN 'Other' ELSE genus END AS genus, p FROM (SELECT dataset, genus, 100.0 * n / sum(n) OVER (PARTITION BY dataset) AS p FROM (SELECT dataset, genus, count(*) AS n FROM genomes GROUP BY ALL))) GROUP BY ALL", "genomes"),
    "percent",
)(lambda t: R.composition(_genomes(t), "dataset", "genus", 4.0))
query("ag11_paf_summary", duck("SELECT query, count(*) AS hits, sum(hit_len)::BIGINT AS hit_len, sum(nm)::BIGINT AS nm, count(*) > 1 AS chimeric, sum(nm) / sum(hit_len) AS nm_ratio FROM paf GROUP BY query", "paf"), "nm_ratio")(lambda t: R.paf_summary(t.view("paf")))
query("ag12_run_totals", duck("SELECT sim_run, sum(s) / 3600 AS hours, sum(cpu_time) / 3600 AS cpu_hours, max(max_vms) / 1024 AS max_gb FROM runs GROUP BY 1", "runs"), "hours cpu_hours max_gb")(lambda t: R.run_totals(t.view("runs"), ["sim_run"]))
query(
    "ag13_throughput",
    duck("SELECT sim_run, avg(r) AS mean_rate, stddev_samp(r) AS sd_rate FROM (SELECT sim_run, n / nullif(s, 0) AS r FROM runs JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = run_id) GROUP BY 1", "runs"),
    "mean_rate sd_rate",
)(lambda t: R.throughput(t["lineitem"].groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("n")), t.view("runs"), "run_id", ["sim_run"]))
query("ag14_insert_size_means", duck("SELECT contig, avg(tlen) AS tlen FROM aln WHERE flag & 2 = 2 GROUP BY contig", "aln"), "tlen")(lambda t: R.group_means(t.view("aln").where("flag & 2 = 2"), ["contig"], ["tlen"]))
query("ag15_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda t: R.repeated_keys(t["lineitem"], ["l_orderkey", "l_linenumber"]))
query(
    "ag16_table_difference",
    """WITH a AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice AS r FROM part WHERE p_partkey % 10 <> 3), b AS (SELECT p_partkey, (p_size + (p_partkey % 7 = 0)::INT)::DOUBLE AS s, p_retailprice AS r FROM part),
      j AS (SELECT a.p_partkey IS NULL OR b.p_partkey IS NULL AS one, a.s AS s1, b.s AS s2, a.r AS r1, b.r AS r2 FROM a FULL JOIN b USING (p_partkey))
      SELECT 'p_size' AS "column", count_if(one) AS one_sided, count_if(NOT one AND s1 IS DISTINCT FROM s2) AS unequal, coalesce(max(abs(s1 - s2)), 0) AS max_abs_diff FROM j
      UNION ALL SELECT 'p_retailprice', count_if(one), count_if(NOT one AND r1 IS DISTINCT FROM r2), coalesce(max(abs(r1 - r2)), 0) FROM j""",
    "max_abs_diff",
)(lambda t: R.table_difference(t["part"].where("p_partkey % 10 <> 3"), t["part"].withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 7 == 0).cast("int")), ["p_partkey"], ["p_size", "p_retailprice"]))
query("ag17_genome_summary", duck("SELECT file, count(*) AS n_contigs, avg(length) AS mean_length, min(length) AS min_length, max(length) AS max_length, avg(avg_coverage) AS mean_coverage, stddev_samp(avg_coverage) AS sd_coverage FROM meta GROUP BY file", "meta"), "mean_length mean_coverage sd_coverage")(
    lambda t: R.genome_summary(t.view("meta"), ["file"])
)
query("ag18_top_mean", "SELECT p_brand, p_type, avg(p_retailprice) AS mean FROM part GROUP BY ALL ORDER BY mean DESC, p_brand, p_type LIMIT 10", "mean")(lambda t: R.top_mean(t["part"], ["p_brand", "p_type"], "p_retailprice", 10))
query(
    "ag19_positive_groups",
    "SELECT c_custkey, c_nationkey, c_custkey % 5 AS rank, r_name FROM customer LEFT JOIN region ON r_regionkey = c_custkey % 5 WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING sum(c_acctbal - 4500) > 0)",
)(lambda t: R.positive_groups_with_null(t["customer"].select("c_custkey", "c_nationkey", (F.col("c_custkey") % 5).alias("rank"), (F.col("c_acctbal") - 4500).alias("v")), ["c_nationkey"], "v", t["region"].select(F.col("r_regionkey").cast("long").alias("rank"), "r_name")).select("c_custkey", "c_nationkey", "rank", "r_name"))

# --- windows

query("wn1_group_size", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) AS group_size, d AS group_distinct FROM part JOIN (SELECT p_brand AS b, count(DISTINCT p_type) AS d FROM part GROUP BY 1) ON b = p_brand")(
    lambda t: R.with_group_size(t["part"], ["p_brand"], "p_type").select("p_partkey", "group_size", "group_distinct")
)
query("wn2_two_ranks", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank_1, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) AS rank_2 FROM part")(
    lambda t: R.two_ranks(t["part"], ["p_brand"], "-p_size", "p_type").select("p_partkey", "rank_1", "rank_2")
)
query("wn3_running_index", 'SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS "index" FROM orders')(lambda t: R.running_index(t["orders"], ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "index"))
query("wn4_random_per_group", f"SELECT p_partkey, p_brand FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {rand('p_partkey', 1)}, p_partkey) <= 3")(lambda t: R.random_per_group(t["part"].select("p_partkey", "p_brand"), ["p_brand"], 3, "p_partkey", 1))
query("wn5_random_rows", f"SELECT p_partkey FROM part ORDER BY {rand('p_partkey', 2)}, p_partkey LIMIT 25")(lambda t: R.random_rows(t["part"].select("p_partkey"), 25, "p_partkey", 2))
query("wn6_random_cap", f"SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {rand('o_orderkey', 3)}, o_orderkey) <= 1 + ({rand('o_custkey', 4)}) % 10")(
    lambda t: R.random_cap_per_group(t["orders"].select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 10, 3)
)
query("wn7_top_k", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20")(lambda t: R.top_k(t["part"].select("p_partkey", "p_size"), [F.desc("p_size"), F.asc("p_partkey")], 20))
query("wn8_attempts", 'SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS attempt FROM orders')(lambda t: R.running_index(t["orders"], ["o_orderpriority", "o_custkey"], ["o_orderkey"], "attempt").select("o_orderkey", "attempt"))
query("wn9_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' OR value > 90 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS context FROM events", "context")(
    lambda t: M.carry_forward(t["events"], F.when((F.col("event_type") == "purchase") | (F.col("value") > 90), F.col("value")), ["user_id"], "event_id", "context", block=1000).select("event_id", "context")
)
query("wn10_abundance_rank", 'SELECT c_custkey, 100 * c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS percent, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rank FROM customer WHERE c_acctbal > 0', "percent")(
    lambda t: R.abundance_rank(t["customer"], "c_nationkey", "c_acctbal").select("c_custkey", "percent", "rank")
)
query("wn11_first_n_of_group", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")(lambda t: R.first_n_of_group(t["orders"].select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], 2).select("o_orderkey"))
query("wn12_percent_of_total", "SELECT o_orderpriority, o_orderstatus, 100 * v / sum(v) OVER (PARTITION BY o_orderpriority) AS percent FROM (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY ALL)", "percent")(
    lambda t: R.percent_of_total(t["orders"].groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("v")), "o_orderpriority", "v").select("o_orderpriority", "o_orderstatus", "percent")
)
query("sr1_sort_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey DESC LIMIT 30")(lambda t: R.top_k(t["orders"].select("o_orderkey", "o_custkey"), [F.asc("o_custkey"), F.desc("o_orderkey")], 30))

query("sr2_head", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100", "l_extendedprice")(
    lambda t: R.top_k(t["lineitem"].select("l_orderkey", "l_linenumber", "l_extendedprice"), [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 100)
)

# --- sets and shapes

query("st1_tagged_union", "SELECT c_custkey AS id, c_nationkey AS nation, 'customer' AS dataset FROM customer UNION ALL SELECT o_orderkey, NULL, 'orders' FROM orders")(
    lambda t: R.tagged_union({"customer": t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), "orders": t["orders"].select(F.col("o_orderkey").alias("id"))})
)
query("st2_overlap_report", "SELECT count_if(a AND b) AS shared, count_if(a AND NOT b) AS only_left, count_if(b AND NOT a) AS only_right, count(*) AS total FROM (SELECT k, max(s = 1) AS a, max(s = 2) AS b FROM (SELECT l_suppkey AS k, 1 AS s FROM lineitem UNION ALL SELECT o_custkey, 2 FROM orders) GROUP BY k)")(
    lambda t: R.overlap_report(t["lineitem"].select(F.col("l_suppkey").alias("k")), t["orders"].select(F.col("o_custkey").alias("k")), ["k"])
)
query("st3_distinct_on", "SELECT DISTINCT p_brand, p_type FROM part")(lambda t: R.distinct_on(t["part"], ["p_brand", "p_type"]))
query("st4_keep_first", "SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")(lambda t: R.keep_first(t["part"].select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"]))
query("st5_group_split", f"SELECT o_orderkey, CASE WHEN u < 60 THEN 'train' WHEN u < 85 THEN 'test' ELSE 'rest' END AS split FROM (SELECT o_orderkey, ({rand('o_custkey', 5)}) % 100 AS u FROM orders)")(
    lambda t: R.group_split(t["orders"].select("o_orderkey", "o_custkey"), "o_custkey", {"train": 60, "test": 25}, 5).select("o_orderkey", "split")
)
query("st6_missing_combinations", "SELECT a.p_brand, b.p_size FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_size FROM part) b WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = a.p_brand AND p.p_size = b.p_size)")(
    lambda t: R.missing_combinations(t["part"].select("p_brand", "p_size"), {"p_brand": t["part"], "p_size": t["part"]})
)
query("st7_set_difference", duck("SELECT contig FROM meta WHERE contig NOT IN (SELECT contig FROM preds)", "meta", "preds"))(lambda t: R.set_difference(t.view("meta").select("contig"), t.view("preds"), ["contig"]))
query("rs1_longer", "SELECT l_orderkey, name, value FROM (UNPIVOT (SELECT l_orderkey, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME name VALUE value)", "value")(lambda t: R.longer(t["lineitem"], ["l_orderkey"], ["l_discount", "l_tax"]))
query("rs2_wider", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS F, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS O, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS P FROM orders GROUP BY 1")(
    lambda t: R.wider(t["orders"].withColumn("one", F.lit(1)), ["o_orderpriority"], "o_orderstatus", "one", ["F", "O", "P"])
)
query(
    "rs3_percent_shared",
    duck("SELECT level, taxon, a, b, 100 * least(a, b) / ((a + b) / 2) AS percent_shared FROM (SELECT level, taxon, count_if(dataset = 0)::DOUBLE AS a, count_if(dataset = 1)::DOUBLE AS b FROM (SELECT dataset, 'genus' AS level, genus AS taxon FROM genomes UNION ALL SELECT dataset, 'species', species FROM genomes) GROUP BY ALL) WHERE a + b > 0", "genomes"),
    "percent_shared",
)(lambda t: R.percent_shared(_genomes(t), "dataset", (0, 1), ["genus", "species"]))
query("rs4_row_per_item", "SELECT p_partkey, unnest(string_split(p_name, 'a')) AS item FROM part")(lambda t: R.row_per_item(t["part"].select("p_partkey", F.col("p_name").alias("item")), "item", "a"))

# --- study set-up

query("cmp1_sim_grid", "SELECT p_brand, n_regionkey::VARCHAR AS region, regexp_replace(p_brand || '_' || n_regionkey, '[:,]+', '-', 'g') AS run FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT n_regionkey FROM nation)")(
    lambda t: Y.sim_grid(t.spark, {"p_brand": t["part"].select("p_brand").distinct(), "region": t["nation"].select(F.col("n_regionkey").cast("string")).distinct()})
)
query("cmp2_input_type", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'real' WHEN o_orderstatus = 'F' THEN 'provided' ELSE 'simulation' END AS kind FROM orders")(
    lambda t: t["orders"].select("o_orderkey", Y.input_type(F.array(F.lit("Taxon"), F.when(F.col("o_orderkey") % 3 == 0, "Read1").otherwise("Fasta"), F.when(F.col("o_orderkey") % 3 == 0, "READ2").otherwise("x"), F.when(F.col("o_orderstatus") == "F", "Bam").otherwise("y"))).alias("kind"))
)
query("cmp6_registry_rows", "SELECT o_custkey || '/megahit/' || o_orderkey || '.tsv.gz' AS feature_file, o_orderkey || '.tsv.gz' AS file_name FROM orders")(
    lambda t: Y.registry_rows(t["orders"].select(F.concat("o_custkey", F.lit("/megahit/"), "o_orderkey", F.lit(".tsv.gz")).alias("path"))).select("feature_file", "file_name")
)
query("cmp3_even_abundance", "SELECT community, taxon, 100 / count(*) OVER (PARTITION BY community) AS perc_rel_abund, row_number() OVER (PARTITION BY community ORDER BY taxon) AS rank FROM (SELECT p_brand AS community, p_partkey AS taxon FROM part)", "perc_rel_abund")(
    lambda t: Y.even_abundance(t["part"].select(F.col("p_brand").alias("community"), F.col("p_partkey").alias("taxon")))
)
query("cmp4_genomes_in_community", "SELECT taxon, min(p_name) AS fasta, any_value(a) AS perc_rel_abund FROM (SELECT p_type AS taxon, p_name FROM part) JOIN (SELECT p_type AS taxon, sum(p_size) - 200 AS a FROM part GROUP BY 1) USING (taxon) WHERE a > 0 GROUP BY taxon".replace("any_value(a)", "any_value(a)::BIGINT"))(
    lambda t: Y.genomes_in_community(t["part"].select(F.col("p_type").alias("taxon"), F.col("p_name").alias("fasta")), t["part"].groupBy(F.col("p_type").alias("taxon")).agg((F.sum("p_size") - 200).alias("perc_rel_abund")))
)
query("cmp5_output_plan", "SELECT run, step, path FROM (SELECT DISTINCT o_orderpriority || o_orderstatus AS run, o_orderpriority || o_orderstatus || '/' || step AS path, step FROM orders, (SELECT unnest(['map', 'features']) AS step)) WHERE path NOT LIKE '%F/map'")(
    lambda t: (lambda runs: Y.output_plan(runs, {"map": "%s/map", "features": "%s/features"}, runs.where("run like '%F'").select(F.concat("run", F.lit("/map")).alias("path"))))(t["orders"].select(F.concat("o_orderpriority", "o_orderstatus").alias("run")).distinct())
)
query("cmp7_resource_estimate", "SELECT o_orderkey, (8.0::DOUBLE + 0.05::DOUBLE * o_custkey + 0.5::DOUBLE * (o_totalprice * 200) / 1000000) * (1 + o_orderkey % 3) AS mem_gb, ceil((8.0::DOUBLE + 0.05::DOUBLE * o_custkey + 0.5::DOUBLE * (o_totalprice * 200) / 1000000) * (1 + o_orderkey % 3) / 8.0::DOUBLE * (1 + o_orderkey % 3))::BIGINT AS hours FROM orders", "mem_gb")(
    lambda t: t["orders"].select("o_orderkey", *(c.alias(n) for n, c in Y.resource_estimate(F.col("o_custkey"), F.col("o_totalprice") * 200, 1 + F.col("o_orderkey") % 3).items()))
)
query("log2_join_accounting", duck("SELECT run_id AS clust_job, l_n FROM runs LEFT JOIN (SELECT l_orderkey, count(*) AS l_n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) ON l_orderkey = run_id", "runs"))(
    lambda t: Y.join_accounting(t.view("runs").select(F.col("run_id").alias("clust_job")), t["lineitem"].where("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("clust_job")).agg(F.count("*").alias("l_n")))
)
query("log3_format_inputs", "SELECT o_orderkey, substr('a' || o_custkey || '.fa,' || o_orderpriority || '.bam', 1, 12) AS inputs FROM orders")(
    lambda t: t["orders"].select("o_orderkey", Y.format_inputs(F.concat(F.lit("x/a"), "o_custkey", F.lit(".fa, y/z/"), "o_orderpriority", F.lit(".bam")), 12).alias("inputs"))
)
