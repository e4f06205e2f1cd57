"""The graph tables as views of the driver's tables; the same SQL text holds in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "b_persona": "SELECT CAST(r_regionkey AS BIGINT) AS persona_id, CASE r_name WHEN 'ASIA' THEN 'System' WHEN 'EUROPE' THEN 'External System' WHEN 'AMERICA' THEN 'Developer' ELSE r_name END AS persona FROM region",
    "b_outcome": "SELECT CAST(n_nationkey AS BIGINT) AS outcome_id, CAST(n_regionkey AS BIGINT) AS persona_id, CASE WHEN n_nationkey < 12 THEN 'Manage Area ' || CAST(n_nationkey % 8 AS STRING) ELSE 'Operate Area ' || CAST(n_nationkey % 10 AS STRING) END AS outcome, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' Portal ' ELSE 'admin' END AS platform, n_nationkey % 4 <> 0 AS cited FROM nation",
    "b_outcome_all": "SELECT c_custkey AS outcome_id, CAST(c_nationkey % 5 AS BIGINT) AS persona_id, CASE c_custkey % 4 WHEN 0 THEN 'Manage  Area ' || CAST(c_custkey % 300 AS STRING) WHEN 1 THEN ' manage area ' || CAST(c_custkey % 300 AS STRING) ELSE 'Operate ' || c_mktsegment || CAST(c_custkey % 500 AS STRING) END AS outcome, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' Portal ' ELSE 'admin' END AS platform, c_custkey % 4 <> 0 AS cited FROM customer",
    "b_scenario": "SELECT c_custkey AS scenario_id, CAST(c_nationkey AS BIGINT) AS outcome_id, c_mktsegment || ' flow ' || CAST(c_custkey % 400 AS STRING) AS scenario, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'handles ' || lower(c_mktsegment) END AS description, c_custkey % 5 <> 0 AS cited, c_acctbal < 0 AS is_design_generated FROM customer",
    "b_step": "SELECT o_orderkey AS step_id, o_custkey AS scenario_id, o_orderpriority AS step, o_orderdate AS created_at FROM orders WHERE o_custkey % 23 <> 0",
    "b_action": "SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS action_id, l_orderkey AS step_id, CASE l_linenumber WHEN 1 THEN CASE l_partkey % 5 WHEN 0 THEN 'Publish sqs://orders/Q' || CAST(l_suppkey AS STRING) || '/' WHEN 1 THEN 'Fetch cron:5m prices' ELSE 'Submit order ' || CAST(l_partkey AS STRING) END WHEN 2 THEN 'Enter quantity' WHEN 3 THEN CASE l_partkey % 3 WHEN 0 THEN 'Click the tab' WHEN 1 THEN 'Open Modal Dialog' ELSE 'Choose a table row' END WHEN 4 THEN 'Receive POST /api/v1/items/' || CAST(l_suppkey AS STRING) WHEN 5 THEN 'Review table' ELSE CASE l_partkey % 4 WHEN 0 THEN 'Save GET /v1/area/{id}/part?a=1' ELSE 'Persist item' END END AS action, CASE WHEN l_discount = 0 THEN NULL WHEN l_discount < 0.03 THEN 'writes the stock table' WHEN l_discount < 0.05 THEN 'goes to s3://bucket/key' WHEN l_discount < 0.06 THEN ' ' ELSE 'keeps line' END AS description, l_quantity > 25 AS has_api, l_suppkey, l_returnflag FROM lineitem",
    "b_api": "SELECT action_id, step_id, CASE WHEN l_suppkey % 9 = 0 THEN 'Event' ELSE 'REST' END AS type, CASE l_returnflag WHEN 'A' THEN 'GET' WHEN 'N' THEN 'post' ELSE NULL END AS method, CASE WHEN l_suppkey % 17 = 0 THEN 'https://ext.example.com/x' WHEN l_suppkey % 19 = 0 THEN 'rel/path' ELSE '/App/Area' || CAST(l_suppkey % 40 AS STRING) || '/{id}/?q=1' END AS url, l_suppkey % 3 = 0 AS is_system, action FROM b_action WHERE has_api",
    "b_journey": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN c_custkey - 1 ELSE c_custkey END AS scenario_id, CASE WHEN c_nationkey % 3 = 1 THEN 'portal' WHEN c_nationkey % 3 = 2 THEN 'Admin' ELSE NULL END AS platform FROM customer WHERE c_custkey % 3 <> 1",
    "b_flow_parent": "SELECT o_orderkey AS child, o_custkey AS parent FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 7 = 0",
    "b_page": "SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ' ') AS name, CASE p_size % 5 WHEN 0 THEN 'LIST' WHEN 1 THEN 'DETAIL' WHEN 2 THEN 'FORM' WHEN 3 THEN 'DASHBOARD' ELSE 'form' END AS page_type, CASE WHEN p_size % 2 = 0 THEN 'web' ELSE ' Mobile ' END AS platform FROM part",
    "b_page_parent": "SELECT DISTINCT l_partkey AS child, l_orderkey AS parent FROM lineitem WHERE l_partkey % 13 <> 0",
    "b_component": "SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'TEMPLATE' WHEN 1 THEN 'ORGANISM' WHEN 2 THEN 'MOLECULE' ELSE 'ATOM' END AS type, CAST(s_nationkey AS BIGINT) AS feature_id FROM supplier",
    "b_component_parent": "SELECT DISTINCT l_suppkey AS child, l_partkey AS parent FROM lineitem",
    "b_file": "SELECT doc_id, source AS repo, source || '/' || lang || CASE doc_id % 6 WHEN 0 THEN '/dist/' WHEN 1 THEN '/tests/' ELSE '/app/' END || 'f' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.cs' ELSE '' END AS path, n_chars AS loc, text, doc_id % 13 <> 0 AS indexed, doc_id % 11 <> 0 AS on_disk FROM documents",
    "b_read": "SELECT doc_id % 40 AS payload_id, path FROM b_file",
    "b_cited": "SELECT doc_id % 40 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS payload_id, CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN 'elsewhere/' || regexp_replace(path, '^.*/', '') ELSE regexp_replace(path, '^.*/', '') END AS reference FROM b_file WHERE indexed",
    "b_body": "SELECT id AS body_id, CASE WHEN id % 11 = 0 THEN NULL ELSE name END AS payload, CASE id % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'u' END AS project_uuid, CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'n' END AS project_name, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 = 0 END AS skip FROM b_page",
    "b_served": "SELECT DISTINCT CASE WHEN type = 'Event' THEN 'listen ' || lower(url) ELSE 'GET ' || upper(url) || ' here' END AS text FROM b_api WHERE is_system",
    "b_template": "SELECT id, CASE id % 5 WHEN 0 THEN 'FormPageLayout' WHEN 1 THEN 'ListPageLayout' WHEN 2 THEN 'DetailPageLayout' WHEN 3 THEN 'DashboardLayout' ELSE name END AS name, type, feature_id FROM b_component",
    "b_template_on": "SELECT child, parent FROM b_component_parent WHERE child % 4 <> 0 UNION ALL SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_suppkey % 4 = 0 AND (p_partkey % 20 = s_suppkey % 20 OR p_partkey % 37 = s_suppkey)",
    "b_repo": "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'solo' ELSE o_orderstatus || '-' || CAST(o_orderkey AS STRING) END AS name, CAST(o_orderdate AS DATE) AS pushed_at, o_orderkey % 7 = 0 AS archived, o_orderkey % 5 = 0 AS fork, o_orderkey % 11 = 0 AS empty, 'https://u:p@Host/R' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '.git' WHEN 1 THEN '/' ELSE '?x=1' END AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'dev' ELSE 'main' END AS branch FROM orders",
    "b_project": "SELECT o_orderkey + 100 AS project_id, CASE WHEN o_orderkey % 9 = 0 THEN 'SOLO' ELSE upper(o_orderstatus) || '-' || CAST(o_orderkey * 2 AS STRING) END AS name, 'http://host/r' || CAST(o_orderkey AS STRING) AS url, CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE 'dev' END AS branch FROM orders WHERE o_custkey % 3 = 0",
    "b_reference": "SELECT path AS file, text || CASE doc_id % 9 WHEN 0 THEN ' orderLine' WHEN 1 THEN ' ORDER_LINE' WHEN 2 THEN ' order-line' WHEN 3 THEN ' order line' WHEN 4 THEN ' preorderlines' ELSE '' END AS text FROM b_file",
    "b_store": "SELECT l_orderkey * 10 + l_linenumber AS store, l_suppkey % 2 = 0 AS read_only, l_partkey % 3 = 0 AS needs_ddl, l_linenumber AS hits, 0.36 + 0.01 * (l_partkey % 9) AS score_min, 0.40 + 0.01 * (l_suppkey % 9) AS score_max FROM lineitem",
    "b_layer": "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'DataLake' WHEN 1 THEN 'EventQueue' WHEN 2 THEN 'Observability' WHEN 3 THEN 'Infrastructure' WHEN 4 THEN 'Services' ELSE NULL END AS layer FROM part",
    "b_pattern": "SELECT repo, CAST(position AS BIGINT) AS position, pattern FROM (SELECT DISTINCT source AS repo, 3 AS position, '*.cs' AS pattern FROM documents UNION ALL SELECT DISTINCT source, 2, '/' || source || '/de/**' FROM documents UNION ALL SELECT DISTINCT source, 1, 'f1*.ts' FROM documents UNION ALL SELECT DISTINCT source, 9, 'never-there/' FROM documents UNION ALL SELECT DISTINCT source, 4, 'fr/app/' FROM documents UNION ALL SELECT DISTINCT source, 5, 'app/' FROM documents WHERE lang = 'es' UNION ALL SELECT source, 100 + doc_id, 'f' || CAST(doc_id AS STRING) || '.py' FROM documents WHERE doc_id % 3 <> 0) AS x",
    "b_status_event": "SELECT event_id, ts, user_id AS repo_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'node_creation' WHEN 'click' THEN 'creating_embeddings' WHEN 'purchase' THEN 'active' ELSE 'error' END AS stage, value FROM events",
    "b_repo_log": "SELECT event_id, ts, CAST(user_id % 200 AS BIGINT) AS repo_id, CASE event_type WHEN 'signup' THEN 'connected' WHEN 'view' THEN 'node_creation' WHEN 'click' THEN 'still_running' WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'retried' WHEN 2 THEN 'retry_check_failed' ELSE 'metadata_addition' END ELSE 'error' END AS stage FROM events",
    "b_intent": "SELECT doc_id, upper(lang) || ': ' || CASE doc_id % 9 WHEN 0 THEN 'Run Docker for ' WHEN 1 THEN 'Render Spinner on ' ELSE '' END || text AS intent FROM documents",
    "b_statement": "SELECT conv_id AS fn, turn AS pos, role AS stype, text FROM conversations",
    "b_field": "SELECT outcome_id AS payload_id, 'Quantity' AS label, 'qty' AS code, true AS editable FROM b_outcome UNION ALL SELECT outcome_id, 'Table Row', 'row', outcome_id % 2 = 0 FROM b_outcome UNION ALL SELECT outcome_id, 'keeps', 'Choose a', true FROM b_outcome UNION ALL SELECT outcome_id, 'Rocket', NULL, true FROM b_outcome UNION ALL SELECT outcome_id, ' ', 'rocket', true FROM b_outcome WHERE outcome_id % 3 = 0",
    "b_type": "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'decimal(' || CAST(c_custkey % 30 + 1 AS STRING) || ', ' || CAST(c_custkey % 7 AS STRING) || ')' WHEN 1 THEN ' NVARCHAR ( ' || CAST(c_custkey % 200 AS STRING) || ' )' WHEN 2 THEN 'int' WHEN 3 THEN 'time stamp' ELSE NULL END AS data_type FROM customer",
    "b_url": "SELECT l_orderkey, l_linenumber, CASE l_suppkey % 9 WHEN 0 THEN '/App/Area' || CAST(l_partkey % 40 AS STRING) || '/{id}/?q=1' WHEN 1 THEN 'Query.users' || CAST(l_partkey % 7 AS STRING) WHEN 2 THEN 'Mutation.save' WHEN 3 THEN 'https://ext.example.com/x/y/:id/z#top' WHEN 4 THEN 'a/b/c/d/e (GET)' WHEN 5 THEN '/{a}/:b' WHEN 6 THEN 'Query.users.all/x' WHEN 7 THEN 'x?y/z' ELSE NULL END AS url FROM lineitem",
    "b_clone": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://user:pw@GitHub.com/Org/Repo.git' WHEN 1 THEN 'ssh://git@bitbucket.org/team/x/' WHEN 2 THEN 'https://dev.azure.com/o/p/_git/r' WHEN 3 THEN 'https://o.visualstudio.com/p/_git/r?v=1' WHEN 4 THEN 'http://gitlab.local/a/b.git/' ELSE url END AS url FROM pages",
    "b_said": "SELECT l_orderkey, l_linenumber, CASE l_partkey % 9 WHEN 0 THEN 'Receive post /api/v1/items/{id}/sub?x=1 now' WHEN 1 THEN 'Publish kafka://topic/A/ and cron:1h' WHEN 2 THEN 'Run cron:0-5/2 daily' WHEN 3 THEN 'Look at /tmp/file and ./x' WHEN 4 THEN '/admin/users/:id' WHEN 5 THEN 'Open /graphql' WHEN 6 THEN 'Visit HTTPS://Ex.example/A/b/' WHEN 7 THEN NULL ELSE 'Nothing of /apiary here' END AS said FROM lineitem",
    "b_node": "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Persona' WHEN 1 THEN 'Outcome' WHEN 2 THEN 'Scenario' WHEN 3 THEN 'Step' WHEN 4 THEN 'Action' ELSE CASE WHEN o_orderkey % 12 = 5 THEN 'Widget' END END AS label, CASE o_custkey % 7 WHEN 0 THEN 'Service' WHEN 1 THEN 'Handle API calls' WHEN 2 THEN NULL WHEN 3 THEN 'Database Admin' ELSE o_orderstatus END AS name, CASE o_custkey % 5 WHEN 0 THEN NULL ELSE 'text' END AS description, CASE o_custkey % 11 WHEN 0 THEN NULL ELSE o_custkey END AS parent_id FROM orders",
    "b_flow": "SELECT o_orderkey AS id, 'Flow ' || CAST(o_orderkey AS STRING) AS name, CASE o_orderkey % 3 WHEN 0 THEN 'portal' WHEN 1 THEN ' Admin ' END AS platform, CASE o_orderkey % 5 WHEN 0 THEN 'WEB' WHEN 1 THEN 'mobile' WHEN 2 THEN 'KIOSK' WHEN 3 THEN 'Hologram' END AS modality, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' tbd ' WHEN 2 THEN 'abc' WHEN 3 THEN 'Description' ELSE 'opens the order' END AS description FROM orders",
    "b_page_on": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'portal' WHEN 1 THEN 'admin' ELSE NULL END AS platform FROM part",
    "b_component_on": "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'Portal' WHEN 1 THEN 'admin' ELSE '' END AS platform FROM supplier",
    "b_uses": "SELECT id, name, 'Supplier#' || lpad(CAST(id + 1 AS STRING), 9, '0') AS used FROM b_component UNION ALL SELECT id, name, 'supplier#' || lpad(CAST(id + 4 AS STRING), 9, '0') FROM b_component WHERE id % 3 <> 0",
    "b_statement_of": "SELECT conv_id AS fn, turn AS pos, CASE turn % 5 WHEN 0 THEN 'if_statement' WHEN 1 THEN 'decorator' WHEN 2 THEN 'query_statement' WHEN 3 THEN 'else_clause' ELSE 'assignment' END AS stype, CASE (conv_id + turn) % 6 WHEN 0 THEN 'if icFlag' || chr(10) || '== 9' WHEN 1 THEN '@view(request_method)' WHEN 2 THEN 'SELECT stock' WHEN 3 THEN 'x' ELSE text END AS text FROM conversations",
    "b_resource": "SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN 'aws_s3_bucket' WHEN 1 THEN 'aws_sqs_queue_policy' WHEN 2 THEN 'x_unknown' WHEN 3 THEN 'google_compute_url_load_balancer' WHEN 4 THEN 'google_compute_network' WHEN 5 THEN 'azurerm_mssql_database' WHEN 6 THEN 'aws_sagemaker_model' WHEN 7 THEN 'aws_lb' WHEN 8 THEN 'kubernetes_ingress_v1' WHEN 9 THEN 'google_compute_disk' WHEN 10 THEN 'aws_cloudwatch_log_group' ELSE NULL END AS rtype FROM part",
    "b_arch": "SELECT 'Services' AS layer, CASE WHEN p_partkey % 8 = 0 THEN upper(p_brand) ELSE p_brand END AS name, CASE p_partkey % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'iac' ELSE 'code' END AS source, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS description, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS technology, CAST(p_size AS STRING) AS region, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'host' || CAST(p_partkey % 5 AS STRING) END AS deployment, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'd' || CAST(p_size % 3 AS STRING) END AS domain_a, 'd' || CAST(p_partkey % 4 AS STRING) AS domain_b FROM part",
    "b_source_text": "SELECT page_id, replace(replace(html, '<p>', CASE page_id % 3 WHEN 0 THEN '<Button x>' WHEN 1 THEN '<mat-tab-group (click)=' ELSE '<div>' END), '<li>', '<li [(ngModel)]') AS text FROM pages",
    "b_observed": "SELECT type, name, l_partkey % 5 AS feature, l_suppkey % 7 % 2 AS app, l_partkey % 50 = 0 AND l_suppkey % 9 = 0 AS shared, CASE WHEN l_linenumber > 2 THEN 'c' || CAST(l_linenumber AS STRING) END AS uses FROM lineitem JOIN b_component ON b_component.id = l_suppkey % 100 WHERE l_suppkey % 4 <> 0 OR l_partkey % 5 < 2",
    "b_change": "SELECT page_id, CASE WHEN page_id % 13 = 0 THEN replace(regexp_replace(url, '^https?://[^/]+/', 'apps/'), 'apps/en/', 'apps/enx/') ELSE regexp_replace(url, '^https?://[^/]+/', 'apps/') END AS path, CASE page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'R' END AS status FROM pages",
    "b_topic": "SELECT scenario_id, outcome_id, CASE scenario_id % 19 WHEN 0 THEN 'Upload Bond prices' WHEN 1 THEN 'Show the P&L report' WHEN 2 THEN 'Waive an exception' WHEN 3 THEN 'FX static data' WHEN 4 THEN 'Audit as PDF' WHEN 5 THEN CASE WHEN outcome_id < 2 THEN 'Set a tolerance' ELSE 'Validate' END WHEN 6 THEN 'expense dashboard' ELSE scenario END AS scenario FROM b_scenario",
    "b_path": "SELECT page_id, CASE WHEN page_id % 29 = 0 THEN NULL ELSE CASE page_id % 16 WHEN 0 THEN 'apps/shop' || CAST(page_id % 3 AS STRING) || '/web/' WHEN 1 THEN 'apps/shop1/api/' WHEN 2 THEN 'libs/ngx-forms/' WHEN 3 THEN 'libs/nest-core/' WHEN 4 THEN 'libs/price-common/' WHEN 5 THEN 'libs/widget' || CAST(page_id % 2 AS STRING) || '/' WHEN 6 THEN 'services/mail/' WHEN 7 THEN 'apps/shop1/web2/' WHEN 8 THEN 'libs/ngx-forms/node_modules/x/' WHEN 9 THEN 'tools/' WHEN 10 THEN 'apps/lambda/' WHEN 11 THEN 'src/pages/' WHEN 12 THEN 'legacy/' WHEN 13 THEN 'libs/plain/deep/er/' ELSE '' END || CASE page_id % 7 WHEN 0 THEN 'src/app/' WHEN 1 THEN 'controllers/' ELSE '' END || CASE page_id % 17 WHEN 0 THEN 'f' || CAST(page_id AS STRING) || '.component.ts' WHEN 1 THEN 'style.css' WHEN 2 THEN 'a' || CAST(page_id AS STRING) || '.ts' WHEN 3 THEN 'package.json' WHEN 4 THEN 'x' || CAST(page_id AS STRING) || '.service.ts' WHEN 5 THEN 'read.md' WHEN 6 THEN 'a.spec.ts' WHEN 7 THEN 'project.json' WHEN 8 THEN 'v' || CAST(page_id AS STRING) || '.vue' WHEN 9 THEN 'Dockerfile' WHEN 10 THEN '.env.local' WHEN 11 THEN 'OrderController.cs' WHEN 12 THEN 'logo.png' WHEN 13 THEN 'handler.ts' WHEN 14 THEN 'docker-compose.dev' WHEN 15 THEN 'yarn.lock' ELSE 'main.go' END END AS path, CASE page_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'R' END AS status FROM pages",
    "b_design_node": "SELECT 'journey' AS label, id, CASE WHEN id % 5 = 0 THEN 'Shared journey' ELSE name END AS name, platform, scenario_id, id % 2 AS seq FROM b_journey UNION ALL SELECT 'flow', id, CASE WHEN id % 9 = 0 THEN ' FLOW ' || CAST(id % 50 AS STRING) ELSE name END, platform, NULL, id % 2 FROM b_flow UNION ALL SELECT 'page', id, name, platform, NULL, id % 2 FROM b_page UNION ALL SELECT 'component', id, CASE WHEN id % 3 = 0 THEN 'Button' ELSE name END, CASE WHEN id % 2 = 0 THEN 'web' END, NULL, id % 2 FROM b_component",
    "b_design_link": "SELECT 'flow' AS label, child, parent FROM b_flow_parent UNION ALL SELECT 'page', child, parent FROM b_page_parent UNION ALL SELECT 'component', child, parent FROM b_component_parent",
}


class Tables:
    """Base tables and views of one scale by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in BASE:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self.made[name] = self.spark.sql(self._seen(VIEWS[name]))
        return self.made[name]


    def links(self, name: str) -> DataFrame:
        """A view of distinct links with those that come twice, for operators to which that is the same: one shuffle of all links less."""
        return self.spark.sql(self._seen(VIEWS[name].replace("SELECT DISTINCT", "SELECT", 1)))

    def _seen(self, sql: str) -> str:
        """The text, once all that it names is there as a view."""
        for other in named_in(sql):
            getattr(self, other).createOrReplaceTempView(other)
        return sql


def named_in(sql: str) -> list[str]:
    """Tables and views that a text names."""
    return [x for x in [*BASE, *VIEWS] if re.search(rf"\b{x}\b", sql)]


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names, and those that these name, as common table expressions."""
    need: set[str] = set()
    left = [x for x in named_in(sql) if x in VIEWS]
    while left:
        name = left.pop()
        if name not in need:
            need.add(name)
            left.extend(x for x in named_in(VIEWS[name]) if x in VIEWS)
    ordered = sorted(need, key=lambda x: (_depth(x), x))
    return f"WITH {', '.join(f'{x} AS ({VIEWS[x]})' for x in ordered)} SELECT * FROM ({sql}) AS q" if need else sql


def _depth(name: str) -> int:
    return 1 + max((_depth(x) for x in named_in(VIEWS[name]) if x in VIEWS), default=0)
