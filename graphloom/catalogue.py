"""Queries over the driver's tables: SPARQL and the same in SQL, one pair for each operator and function."""

from __future__ import annotations

#: name: (SPARQL, SQL)
SPARQL: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "SELECT ?name (COUNT(?order) AS ?order_count) (SUM(?amount) AS ?spend) WHERE { ?order :o_custkey ?c ; :o_totalprice ?amount . ?c :c_name ?name } GROUP BY ?name ORDER BY DESC(?order_count) ?name LIMIT 20",
        "SELECT c_name AS name, count(*) AS order_count, round(sum(o_totalprice), 2) AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name ORDER BY order_count DESC, name LIMIT 20",
    ),
    "bgp_star": (
        "SELECT ?k ?price ?day WHERE { ?o :o_orderkey ?k ; :o_totalprice ?price ; :o_orderdate ?day ; :o_orderstatus 'F' }",
        "SELECT o_orderkey AS k, o_totalprice AS price, o_orderdate AS day FROM orders WHERE o_orderstatus = 'F'",
    ),
    "bgp_chain_fk": (
        "SELECT ?k ?nation WHERE { ?o :o_orderkey ?k ; :o_custkey/:c_nationkey/:n_name ?nation }",
        "SELECT DISTINCT o_orderkey AS k, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "bgp_snowflake": (
        "SELECT ?region (COUNT(*) AS ?n) WHERE { ?l :l_orderkey ?o ; :l_quantity ?q . ?o :o_custkey ?c . ?c :c_nationkey ?n1 . ?n1 :n_regionkey ?r . ?r :r_name ?region FILTER(?q > 40) } GROUP BY ?region",
        "SELECT r_name AS region, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 40 GROUP BY r_name",
    ),
    "bgp_cycle4": (
        "SELECT (COUNT(*) AS ?n) WHERE { ?l :l_orderkey ?o ; :l_suppkey ?s . ?o :o_custkey ?c . ?c :c_nationkey ?x . ?s :s_nationkey ?x }",
        "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey",
    ),
    "bgp_repeated_var": (
        "SELECT ?k ?x WHERE { ?l :l_linenumber ?x ; :l_suppkey ?s ; :l_orderkey ?o . ?s :s_suppkey ?x . ?o :o_orderkey ?k }",
        "SELECT l_orderkey AS k, l_linenumber::BIGINT AS x FROM lineitem WHERE l_linenumber = l_suppkey",
    ),
    "bgp_ground": (
        "SELECT ?name WHERE { <urn:tpch:nation/3> :n_nationkey 3 . ?r :r_name ?name }",
        "SELECT r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3)",
    ),
    "bgp_ground_missing": (
        "SELECT ?name WHERE { <urn:tpch:nation/3> :n_nationkey 4 . ?r :r_name ?name }",
        "SELECT r_name AS name FROM region WHERE FALSE",
    ),
    "bgp_cross": (
        "SELECT ?a ?b WHERE { ?r :r_name ?a . ?n :n_name ?b }",
        "SELECT r_name AS a, n_name AS b FROM region, nation",
    ),
    "bgp_var_predicate": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s :n_name ?name ; ?p ?v } GROUP BY ?p",
        """SELECT '<' || p || '>' AS p, count(*) AS n FROM (SELECT unnest(['urn:tpch:n_nationkey', 'urn:tpch:n_name', 'urn:tpch:n_regionkey', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type']) AS p FROM nation) GROUP BY p""",
    ),
    "bgp_unknown_constant": ("SELECT ?s WHERE { ?s :c_name 'nobody of this name' }", "SELECT 'urn:tpch:customer/' || c_custkey AS s FROM customer WHERE FALSE"),
    "bgp_type": ("SELECT (COUNT(*) AS ?n) WHERE { ?s a :customer }", "SELECT count(*) AS n FROM customer"),
    "bgp_bnode": ("SELECT ?name WHERE { [ :c_nationkey [ :n_name ?name ] ; :c_acctbal ?b ] FILTER(?b > 9000) }", "SELECT n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000"),
    "ask_true": ("ASK { ?r :r_regionkey 1 }", "SELECT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 1) AS answer"),
    "ask_false": ("ASK { ?r :r_regionkey 99 }", "SELECT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 99) AS answer"),
    "construct": (
        "CONSTRUCT { ?n <urn:x:in> ?r . ?n <urn:x:name> ?name } WHERE { ?n :n_regionkey ?r ; :n_name ?name }",
        "SELECT '<urn:tpch:nation/' || n_nationkey || '>' AS s, '<urn:x:in>' AS p, '<urn:tpch:region/' || n_regionkey || '>' AS o FROM nation UNION ALL SELECT '<urn:tpch:nation/' || n_nationkey || '>', '<urn:x:name>', '\"' || n_name || '\"' FROM nation",
    ),
    "describe": (
        "DESCRIBE ?r WHERE { ?r :r_regionkey 2 }",
        """SELECT '<urn:tpch:region/2>' AS s, p, o FROM (SELECT unnest([{'p': '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', 'o': '<urn:tpch:region>'}, {'p': '<urn:tpch:r_name>', 'o': '"' || r_name || '"'}, {'p': '<urn:tpch:r_regionkey>', 'o': '"2"^^<http://www.w3.org/2001/XMLSchema#integer>'}], recursive := true) FROM region WHERE r_regionkey = 2)""",
    ),
    # filters and truth
    "filter_numeric": ("SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_totalprice ?p FILTER(?p >= 100000 && ?p < 150000) }", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000"),
    "filter_text_order": ("SELECT ?n WHERE { ?c :c_name ?n FILTER(?n < 'Customer#000000050') }", "SELECT c_name AS n FROM customer WHERE c_name < 'Customer#000000050'"),
    "filter_date": (
        "SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_orderdate ?d FILTER(?d >= '1995-01-01T00:00:00'^^xsd:dateTime && ?d < '1996-01-01T00:00:00'^^xsd:dateTime) }",
        "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
    ),
    "filter_in": ("SELECT ?k WHERE { ?o :o_orderkey ?k ; :o_orderpriority ?p FILTER(?p IN ('1-URGENT', '2-HIGH')) }", "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_in_by_value": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s FILTER(?s IN (1.0, '2', 3)) }", "SELECT p_partkey AS k FROM part WHERE p_size IN (1, 2, 3)"),
    "filter_not_in": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s FILTER(?s NOT IN (1, 2, 3)) }", "SELECT p_partkey AS k FROM part WHERE p_size NOT IN (1, 2, 3)"),
    "filter_equality_is_of_terms": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s FILTER(?s = 1.0) }", "SELECT p_partkey AS k FROM part WHERE FALSE"),
    "filter_equal": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s FILTER(?s = 7) }", "SELECT p_partkey AS k FROM part WHERE p_size = 7"),
    "filter_not_equal": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s FILTER(?s != 7) }", "SELECT p_partkey AS k FROM part WHERE p_size <> 7"),
    "filter_same_term": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s FILTER(sameTerm(?s, ?k)) }", "SELECT p_partkey AS k FROM part WHERE p_size = p_partkey"),
    "filter_or": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s FILTER(?s < 3 || ?s > 48) }", "SELECT p_partkey AS k FROM part WHERE p_size < 3 OR p_size > 48"),
    "filter_error_is_false": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_name ?n FILTER(?n + 1 > 0 || ?k < 5) }", "SELECT c_custkey AS k FROM customer WHERE c_custkey < 5"),
    "filter_not_error_is_true": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_name ?n FILTER(!(?n + 1 > 0)) }", "SELECT c_custkey AS k FROM customer"),
    "filter_unbound_pair_equal": ("SELECT ?k WHERE { ?r :r_regionkey ?k FILTER(?u = ?v) }", "SELECT r_regionkey::BIGINT AS k FROM region"),
    "ebv_string": ("SELECT ?k WHERE { ?c :c_custkey ?k ; :c_mktsegment ?s FILTER(?s) }", "SELECT c_custkey AS k FROM customer WHERE length(c_mktsegment) > 0"),
    "ebv_number": ("SELECT ?k WHERE { ?n :n_nationkey ?k FILTER(?k) }", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey <> 0"),
    "ebv_iri_is_false": ("SELECT ?k WHERE { ?n :n_nationkey ?k FILTER(?n) }", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE FALSE"),
    # OPTIONAL, UNION, VALUES
    "optional": (
        "SELECT ?k ?q WHERE { ?o :o_orderkey ?k ; :o_orderstatus 'P' OPTIONAL { ?l :l_orderkey ?o ; :l_quantity ?q } }",
        "SELECT o_orderkey AS k, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'",
    ),
    "optional_filter_in_match": (
        "SELECT ?k ?q WHERE { ?o :o_orderkey ?k ; :o_totalprice ?t OPTIONAL { ?l :l_orderkey ?o ; :l_quantity ?q FILTER(?q > 49 && ?t > 300000) } }",
        "SELECT o_orderkey AS k, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 49 AND o_totalprice > 300000",
    ),
    "optional_unmatched": (
        "SELECT ?k WHERE { ?o :o_orderkey ?k OPTIONAL { ?l :l_orderkey ?o ; :l_quantity ?q } FILTER(!BOUND(?q)) }",
        "SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    ),
    "optional_chain_null_join": (
        "SELECT ?n ?r ?x WHERE { ?n :n_nationkey ?k OPTIONAL { ?n :n_regionkey ?r FILTER(?k < 3) } OPTIONAL { ?r :r_name ?x } }",
        """SELECT 'urn:tpch:nation/' || n_nationkey AS n, 'urn:tpch:region/' || coalesce(n2.n_regionkey, r_regionkey) AS r, r_name AS x
           FROM nation n1 LEFT JOIN (SELECT n_nationkey AS k, n_regionkey FROM nation WHERE n_nationkey < 3) n2 ON n1.n_nationkey = n2.k JOIN region ON n2.n_regionkey IS NULL OR n2.n_regionkey = r_regionkey""",
    ),
    "optional_count_distinct": (
        "SELECT ?seg (COUNT(DISTINCT ?o) AS ?n) WHERE { ?c :c_mktsegment ?seg OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > 200000) } } GROUP BY ?seg",
        "SELECT c_mktsegment AS seg, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_mktsegment",
    ),
    "union_schema_merge": (
        "SELECT ?a ?b WHERE { { ?r :r_name ?a } UNION { ?n :n_name ?b } }",
        "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation",
    ),
    "union_join_unbound": (
        "SELECT ?r ?a ?b WHERE { { ?r :r_name ?a } UNION { ?n :n_name ?b FILTER(?b < 'NATION_11') } ?r :r_regionkey 1 }",
        "SELECT 'urn:tpch:region/1' AS r, r_name AS a, NULL::VARCHAR AS b FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'urn:tpch:region/1', NULL, n_name FROM nation WHERE n_name < 'NATION_11'",
    ),
    "values": ("SELECT ?k ?n WHERE { VALUES ?r { <urn:tpch:region/0> <urn:tpch:region/3> } ?x :n_regionkey ?r ; :n_nationkey ?k ; :n_name ?n }", "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation WHERE n_regionkey IN (0, 3)"),
    "values_undef": (
        "SELECT ?k ?tag WHERE { ?n :n_nationkey ?k ; :n_regionkey ?r VALUES (?r ?tag) { (<urn:tpch:region/0> 'zero') (UNDEF 'any') } }",
        "SELECT n_nationkey::BIGINT AS k, '\"zero\"' AS tag FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey::BIGINT, '\"any\"' FROM nation",
    ),
    "distinct": ("SELECT DISTINCT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "bind": ("SELECT ?k ?v WHERE { ?p :p_partkey ?k ; :p_retailprice ?r ; :p_size ?s BIND(?r * ?s AS ?v) }", "SELECT p_partkey AS k, p_retailprice * p_size AS v FROM part"),
    "bind_error_unbound": ("SELECT ?k ?v WHERE { ?p :p_partkey ?k ; :p_name ?n BIND(?n * 2 AS ?v) }", "SELECT p_partkey AS k, NULL::DOUBLE AS v FROM part"),
    "subselect": (
        "SELECT ?name ?n WHERE { ?c :c_name ?name { SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :o_custkey ?c } GROUP BY ?c } FILTER(?n > 12) }",
        "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE n > 12",
    ),
    # aggregates
    "count_star": ("SELECT (COUNT(*) AS ?n) WHERE { ?l :l_quantity ?q }", "SELECT count(*) AS n FROM lineitem"),
    "count_distinct": ("SELECT (COUNT(DISTINCT ?c) AS ?n) WHERE { ?o :o_custkey ?c }", "SELECT count(DISTINCT o_custkey) AS n FROM orders"),
    "count_distinct_star": (
        "SELECT (COUNT(DISTINCT *) AS ?n) WHERE { SELECT ?s ?p WHERE { ?o :o_orderstatus ?s ; :o_orderpriority ?p } }",
        "SELECT count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)",
    ),
    "grouped_count": ("SELECT ?f ?s (COUNT(*) AS ?n) WHERE { ?l :l_returnflag ?f ; :l_linestatus ?s } GROUP BY ?f ?s", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL"),
    "sum_avg_min_max": (
        "SELECT ?f (ROUND(SUM(?q)) AS ?total) (ROUND(AVG(?q) * 1000) AS ?mean) (MIN(?p) AS ?lo) (MAX(?p) AS ?hi) WHERE { ?l :l_returnflag ?f ; :l_quantity ?q ; :l_extendedprice ?p } GROUP BY ?f",
        "SELECT l_returnflag AS f, floor(sum(l_quantity) + 0.5) AS total, floor(avg(l_quantity) * 1000 + 0.5) AS mean, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag",
    ),
    "sum_distinct": ("SELECT (SUM(DISTINCT ?s) AS ?total) WHERE { ?p :p_size ?s }", "SELECT sum(DISTINCT p_size)::DOUBLE AS total FROM part"),
    "sum_skips_text": ("SELECT (SUM(?n) AS ?total) WHERE { ?c :c_name ?n }", "SELECT 0::DOUBLE AS total"),
    "min_max_text": ("SELECT (MIN(?n) AS ?lo) (MAX(?n) AS ?hi) WHERE { ?c :c_name ?n }", "SELECT min(c_name) AS lo, max(c_name) AS hi FROM customer"),
    "min_max_time": ("SELECT ?s (MIN(?d) AS ?first) (MAX(?d) AS ?last) WHERE { ?o :o_orderstatus ?s ; :o_orderdate ?d } GROUP BY ?s", "SELECT o_orderstatus AS s, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus"),
    "sample": ("SELECT ?s (SAMPLE(?s) AS ?x) WHERE { ?o :o_orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, o_orderstatus AS x FROM orders GROUP BY o_orderstatus"),
    "group_concat": (
        "SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR='|') AS ?names) WHERE { ?x :n_regionkey/:r_name ?r ; :n_name ?n } GROUP BY ?r",
        "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "having": ("SELECT ?c (COUNT(*) AS ?n) WHERE { ?o :o_custkey ?x . ?x :c_name ?c } GROUP BY ?c HAVING(COUNT(*) > 15)", "SELECT c_name AS c, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name HAVING count(*) > 15"),
    "group_by_expression": ("SELECT ?y (COUNT(*) AS ?n) WHERE { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "group_by_unbound": (
        "SELECT ?x (COUNT(*) AS ?n) WHERE { ?o :o_orderkey ?k OPTIONAL { ?o :o_orderstatus ?x FILTER(?k < 100) } } GROUP BY ?x",
        "SELECT CASE WHEN o_orderkey < 100 THEN o_orderstatus END AS x, count(*) AS n FROM orders GROUP BY 1",
    ),
    "aggregate_of_nothing": (
        "SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?s) (AVG(?k) AS ?a) (MIN(?k) AS ?m) WHERE { ?r :r_regionkey ?k FILTER(?k > 99) }",
        "SELECT 0::BIGINT AS n, 0::DOUBLE AS s, 0::DOUBLE AS a, NULL::BIGINT AS m",
    ),
    # order and slices
    "order_desc_nulls": (
        "SELECT ?k ?q WHERE { ?o :o_orderkey ?k OPTIONAL { ?o :o_totalprice ?q FILTER(?q > 100000) } } ORDER BY DESC(?q) ?k LIMIT 30",
        "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS q FROM orders ORDER BY q DESC NULLS LAST, k LIMIT 30",
    ),
    "order_asc_nulls_first": (
        "SELECT ?k ?q WHERE { ?o :o_orderkey ?k OPTIONAL { ?o :o_totalprice ?q FILTER(?q > 100000) } } ORDER BY ?q ?k LIMIT 30",
        "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS q FROM orders ORDER BY q NULLS FIRST, k LIMIT 30",
    ),
    "slice": ("SELECT ?k WHERE { ?o :o_orderkey ?k } ORDER BY ?k LIMIT 10 OFFSET 95", "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 10 OFFSET 95"),
    "order_by_expression": ("SELECT ?k WHERE { ?p :p_partkey ?k ; :p_size ?s } ORDER BY DESC(?s * 2) ?k LIMIT 15", "SELECT p_partkey AS k FROM part ORDER BY p_size DESC, k LIMIT 15"),
    # functions
    "fn_str": ("SELECT (STR(?n) AS ?a) (STR(?k) AS ?b) WHERE { ?n :n_nationkey ?k }", "SELECT 'urn:tpch:nation/' || n_nationkey AS a, n_nationkey::VARCHAR AS b FROM nation"),
    "fn_strlen": ("SELECT ?k (STRLEN(?n) AS ?l) WHERE { ?p :p_partkey ?k ; :p_name ?n }", "SELECT p_partkey AS k, length(p_name) AS l FROM part"),
    "fn_substr": ("SELECT ?k (SUBSTR(?n, 3, 4) AS ?a) (SUBSTR(?n, 5) AS ?b) (SUBSTR(?n, 0, 4) AS ?c) WHERE { ?p :p_partkey ?k ; :p_name ?n }", "SELECT p_partkey AS k, substr(p_name, 3, 4) AS a, substr(p_name, 5) AS b, substr(p_name, 1, 4) AS c FROM part"),
    "fn_case": ("SELECT (UCASE(?n) AS ?a) (LCASE(?n) AS ?b) WHERE { ?c :c_name ?n }", "SELECT upper(c_name) AS a, lower(c_name) AS b FROM customer"),
    "fn_text_tests": (
        "SELECT ?k (STRSTARTS(?n, 'Customer#0000001') AS ?a) (STRENDS(?n, '7') AS ?b) (CONTAINS(?n, '12') AS ?c) WHERE { ?x :c_custkey ?k ; :c_name ?n }",
        "SELECT c_custkey AS k, starts_with(c_name, 'Customer#0000001') AS a, ends_with(c_name, '7') AS b, contains(c_name, '12') AS c FROM customer",
    ),
    "fn_before_after": (
        "SELECT ?k (STRBEFORE(?n, '#') AS ?a) (STRAFTER(?n, '#') AS ?b) (STRBEFORE(?n, 'zz') AS ?c) (STRAFTER(?n, '') AS ?d) WHERE { ?x :c_custkey ?k ; :c_name ?n }",
        "SELECT c_custkey AS k, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b, '' AS c, c_name AS d FROM customer",
    ),
    "fn_concat": ("SELECT (CONCAT(?n, '/', ?s) AS ?a) (CONCAT(?n, ?nothing) AS ?b) WHERE { ?x :c_name ?n ; :c_mktsegment ?s }", "SELECT c_name || '/' || c_mktsegment AS a, NULL::VARCHAR AS b FROM customer"),
    "fn_replace": ("SELECT (REPLACE(?n, '0+([1-9])', '<$1>') AS ?a) (REPLACE(?n, 'CUST', 'x', 'i') AS ?b) WHERE { ?x :c_name ?n }", r"SELECT regexp_replace(c_name, '0+([1-9])', '<\1>', 'g') AS a, regexp_replace(c_name, '(?i)CUST', 'x', 'g') AS b FROM customer"),
    "fn_regex": ("SELECT ?n WHERE { ?x :c_name ?n FILTER(REGEX(?n, 'R#0+[0-9]5$', 'i')) }", "SELECT c_name AS n FROM customer WHERE regexp_matches(c_name, '(?i)R#0+[0-9]5$')"),
    "fn_regex_invalid": ("SELECT ?n WHERE { ?x :r_name ?n FILTER(!REGEX(?n, '(')) }", "SELECT r_name AS n FROM region"),
    "fn_lang_datatype": (
        "SELECT ?k (LANG(?n) AS ?l) (DATATYPE(?b) AS ?d) (DATATYPE(?n) AS ?e) (LANGMATCHES('en-US', 'en') AS ?m) WHERE { ?x :c_custkey ?k ; :c_name ?n ; :c_acctbal ?b }",
        "SELECT c_custkey AS k, '' AS l, '<http://www.w3.org/2001/XMLSchema#double>' AS d, '<http://www.w3.org/2001/XMLSchema#string>' AS e, true AS m FROM customer",
    ),
    "fn_numeric": (
        "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) WHERE { ?x :c_custkey ?k ; :c_acctbal ?b }",
        "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, floor(c_acctbal + 0.5) AS r FROM customer",
    ),
    "fn_arithmetic": (
        "SELECT ?k (?s + 1 AS ?a) (?s - 2 AS ?b) (?s * 3 AS ?c) (?s / 4 AS ?d) (-?s AS ?e) (?s / (?s - ?s) AS ?f) WHERE { ?p :p_partkey ?k ; :p_size ?s }",
        "SELECT p_partkey AS k, p_size + 1.0::DOUBLE AS a, p_size - 2.0::DOUBLE AS b, p_size * 3.0::DOUBLE AS c, p_size / 4.0::DOUBLE AS d, -p_size::DOUBLE AS e, NULL::DOUBLE AS f FROM part",
    ),
    "fn_date_parts": (
        "SELECT ?k (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?i) (FLOOR(SECONDS(?t)) AS ?s) WHERE { ?e :event_id ?k ; :ts ?t }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS i, second(ts)::DOUBLE AS s FROM events",
    ),
    "fn_kinds": (
        "SELECT ?k (ISIRI(?n) AS ?a) (ISBLANK(?n) AS ?b) (ISLITERAL(?k) AS ?c) (ISNUMERIC(?k) AS ?d) (ISNUMERIC(?name) AS ?e) (ISIRI(?none) AS ?f) WHERE { ?n :n_nationkey ?k ; :n_name ?name }",
        "SELECT n_nationkey::BIGINT AS k, true AS a, false AS b, true AS c, true AS d, false AS e, NULL::BOOLEAN AS f FROM nation",
    ),
    "fn_if": ("SELECT ?k (IF(?s > 25, 'big', 'small') AS ?a) (IF(?n > 0 && ?n + 1 > 0, 1, 2) AS ?b) WHERE { ?p :p_partkey ?k ; :p_size ?s ; :p_name ?n }", "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN '\"big\"' ELSE '\"small\"' END AS a, '\"2\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS b FROM part"),
    "fn_coalesce": ("SELECT ?k (COALESCE(?nothing, ?n + 1, ?n) AS ?a) WHERE { ?r :r_regionkey ?k ; :r_name ?n }", "SELECT r_regionkey::BIGINT AS k, '\"' || r_name || '\"' AS a FROM region"),
    "fn_bound": ("SELECT ?k (BOUND(?q) AS ?b) WHERE { ?o :o_orderkey ?k OPTIONAL { ?o :o_totalprice ?q FILTER(?q > 250000) } }", "SELECT o_orderkey AS k, o_totalprice > 250000 AS b FROM orders"),
    # paths
    "path_sequence": ("SELECT ?c ?r WHERE { ?c :c_nationkey/:n_regionkey ?r }", "SELECT DISTINCT 'urn:tpch:customer/' || c_custkey AS c, 'urn:tpch:region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "path_inverse": ("SELECT ?r ?n WHERE { ?r ^:n_regionkey ?n }", "SELECT DISTINCT 'urn:tpch:region/' || n_regionkey AS r, 'urn:tpch:nation/' || n_nationkey AS n FROM nation"),
    "path_alternative": ("SELECT ?x ?n WHERE { ?x :c_nationkey|:s_nationkey ?n }", "SELECT DISTINCT '<urn:tpch:customer/' || c_custkey || '>' AS x, 'urn:tpch:nation/' || c_nationkey AS n FROM customer UNION SELECT '<urn:tpch:supplier/' || s_suppkey || '>', 'urn:tpch:nation/' || s_nationkey FROM supplier"),
    "path_optional": ("SELECT ?x WHERE { <urn:tpch:nation/4> :n_regionkey? ?x }", "SELECT '<urn:tpch:nation/4>' AS x UNION SELECT '<urn:tpch:region/' || n_regionkey || '>' FROM nation WHERE n_nationkey = 4"),
    "path_negated": (
        "SELECT ?p WHERE { <urn:tpch:region/1> !(:r_name|rdf:type) ?p }",
        "SELECT '\"1\"^^<http://www.w3.org/2001/XMLSchema#integer>' AS p",
    ),
    "path_plus": (
        "SELECT ?x ?y WHERE { ?x (:o_custkey|:c_nationkey|:n_regionkey)+ ?y }",
        """WITH edges AS (SELECT 'orders/' || o_orderkey AS x, 'customer/' || o_custkey AS y FROM orders UNION SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation),
           two AS (SELECT a.x, b.y FROM edges a JOIN edges b ON a.y = b.x), three AS (SELECT a.x, b.y FROM two a JOIN edges b ON a.y = b.x)
           SELECT '<urn:tpch:' || x || '>' AS x, '<urn:tpch:' || y || '>' AS y FROM (SELECT x, y FROM edges UNION SELECT x, y FROM two UNION SELECT x, y FROM three)""",
    ),
    "path_plus_ground": (
        "SELECT ?y WHERE { <urn:tpch:orders/7> (:o_custkey|:c_nationkey|:n_regionkey)+ ?y }",
        """SELECT unnest(['<urn:tpch:customer/' || o_custkey || '>', '<urn:tpch:nation/' || c_nationkey || '>', '<urn:tpch:region/' || n_regionkey || '>']) AS y
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 7""",
    ),
    "path_star": (
        "SELECT ?y WHERE { <urn:tpch:customer/9> (:c_nationkey|:n_regionkey)* ?y }",
        """SELECT unnest(['<urn:tpch:customer/9>', '<urn:tpch:nation/' || c_nationkey || '>', '<urn:tpch:region/' || n_regionkey || '>']) AS y
           FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 9""",
    ),
    "path_star_pairs": (
        "SELECT (COUNT(*) AS ?n) WHERE { ?x :n_regionkey* ?y }",
        "SELECT (SELECT count(*) FROM nation) * 2 + (SELECT count(DISTINCT n_regionkey) FROM nation) AS n",
    ),
}
