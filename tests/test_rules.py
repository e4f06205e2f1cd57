"""Rules of change sets, interfaces and merges on small tables that take every branch."""

import pytest

from graphspark.operators import changes, interfaces, merges, repos


def test_repos_behind_is_null_safe(spark):
    rows = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", None), ("d", "c1"), ("e", None)], "key string, commit string")
    heads = spark.createDataFrame([("a", "c1"), ("b", "c2"), ("c", "c1"), ("d", None), ("d", None)], "key string, head string")
    assert {r.key: r.state for r in repos.repos_behind(rows, heads).collect()} == {"a": "current", "b": "behind", "c": "behind", "d": "unreadable", "e": "unreadable"}


def test_scopes_and_workspaces_end_at_folders(spark):
    paths = ["apps/en/a", "apps/enx/a", "apps/en", "apps/fr/x/y", "other", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path for r in changes.scope_filter(df, ["apps/en/", "/apps/fr"]).collect()} == {"apps/en/a", "apps/en", "apps/fr/x/y"}
    assert changes.scope_filter(df, []).count() == len(paths)
    spaces = spark.createDataFrame([("apps/en/", "backend"), ("apps", "shared-both")], "ws string, wtype string")
    got = {r.path: (r.workspace, r.wtype) for r in changes.assign_workspace(df, spaces).collect()}
    assert got == {"apps/en/a": ("apps/en", "backend"), "apps/enx/a": ("apps", "shared-both"), "apps/en": ("apps/en", "backend"), "apps/fr/x/y": ("apps", "shared-both"), "other": (None, "irrelevant"), None: (None, "irrelevant")}


@pytest.mark.parametrize("path,kind", [("src/pages/a.ts", "frontend"), ("x/src/app/a.ts", "frontend"), ("a/Order.vue", "frontend"), ("a/services/x.go", "backend"), ("pages/x.controller.ts", "backend"), ("a/OrderController.cs", "backend"), ("lib/x.go", "irrelevant"), ("mypages/x.go", "irrelevant")])
def test_types_by_path(spark, path, kind):
    assert changes.assign_workspace(spark.createDataFrame([(path,)], "path string"), spark.createDataFrame([], "ws string, wtype string")).first().wtype == kind


def test_workspaces_from_files(spark):
    files = """apps/a/web/package.json apps/a/web/src/x.ts apps/a/api/package.json libs/ngx-x/project.json libs/nest-y/package.json libs/express-z/package.json libs/q-common/package.json
        libs/u/package.json libs/u/x.component.ts libs/u/inner/package.json libs/u/inner/y.service.ts libs/w/package.json libs/w/handler.ts libs/v/package.json package.json apps/lambda/package.json libs/t-index-structure/package.json"""
    df = spark.createDataFrame([(p,) for p in files.split()], "path string")
    got = {r.ws: (r.wtype, r.framework) for r in changes.workspace_map(df).collect()}
    assert got == {
        "apps/a/web": ("frontend", "detect"), "apps/a/api": ("backend", "detect"), "libs/ngx-x": ("shared-frontend", "angular"), "libs/nest-y": ("shared-backend", "nestjs"), "libs/express-z": ("shared-backend", "express"),
        "libs/q-common": ("shared-both", "other"), "libs/u": ("frontend", "angular"), "libs/u/inner": ("backend", "nestjs"), "libs/w": ("backend", "lambda"), "libs/v": ("shared-both", "other"), "apps/lambda": ("backend", "lambda"),
        "libs/t-index-structure": ("shared-backend", "other"),
    }


def test_irrelevant_files(spark):
    kept = ["a/x.ts", "project.json", "a/ui/style.css", "a/ui/x.vue", "a/latest.ts"]
    dropped = ["a/x.md", "a/x.json", "docs/project.json", "a/style.css", "a/x.spec.ts", "a/x_test.py", "node_modules/a/x.ts", ".env.local", "docker-compose.yml", "a/Makefile", "tools/x.py", "a/b/dist/x.js"]
    df = spark.createDataFrame([(p,) for p in [*kept, *dropped]], "path string")
    assert {r.path for r in changes.exclude_irrelevant(df).collect()} == set(kept)
    assert {r.path for r in changes.exclude_irrelevant(df, df.union(spark.createDataFrame([("a/y.tsx",)], "path string"))).collect()} == {*kept, "a/style.css"}


def test_directions_and_quadrants(spark):
    rows = [("REST", "/a/{x}", False, "Submit the form"), ("REST", "/A/{id}?q", True, "Receive GET /a"), ("REST", "/b", True, "Call the billing"), ("REST", "/b/", True, "handle it"), ("REST", "/c", True, "Write the stock table"), ("REST", "https://x/y", True, "Invoke partner"), ("Event", "/d", True, "Consume the topic"), ("REST", "/e", False, "Receive a letter")]
    got = {(r.type, r.path): (r.n_outbound, r.n_inbound, r.kind) for r in interfaces.interface_quadrants(spark.createDataFrame(rows, "type string, url string, is_system boolean, action string")).collect()}
    assert got == {("REST", "/a/:p"): (1, 1, "human-system"), ("REST", "/b"): (1, 1, "system-system"), ("REST", "https://x/y"): (1, 0, "dangling-outbound"), ("Event", "/d"): (0, 1, "dangling-inbound"), ("REST", "/e"): (1, 0, "dangling-outbound")}


def test_children_after_equivalence(spark):
    pairs = lambda *x: spark.createDataFrame(x, "key string, child string")
    same = spark.createDataFrame([("Btn", "Button"), ("Lbl", "Label")], "name string, as_name string")
    got = interfaces.children_drift(pairs(("a", "Btn"), ("a", "Button"), ("a", "Lbl"), ("b", "x")), pairs(("a", "Button"), ("a", "Icon"), ("b", "y")), same).collect()
    assert {r.key: (r.left_only, r.right_only, r.common) for r in got} == {"a": (1, 1, 1), "b": (1, 1, 0)}


def test_names_with_signs_stay_apart(spark):
    """Persona `a > b` with outcome `c`, and persona `a` with outcome `b > c`: two outcomes."""
    side = {
        "persona": spark.createDataFrame([(1, "a > b"), (2, "a"), (3, "a|x")], "persona_id long, persona string"),
        "outcome": spark.createDataFrame([(1, 1, "c", None), (2, 2, "b > c", None), (3, 3, "c", "x|y"), (4, 2, "b \\> c", None)], "outcome_id long, persona_id long, outcome string, platform string"),
    }
    found = merges.merge_tree(side, {k: v.limit(0) for k, v in side.items()}).where("level = 'outcome'").collect()
    assert len(found) == 4 == len({r.key_id for r in found})


def _graph(spark):
    nodes = [
        ("journey", 1, "Buy", None, 7, 0), ("journey", 2, "buy ", None, 7, 1), ("journey", 3, "Buy", None, 8, 0), ("journey", 4, "BUY", None, None, 1), ("journey", 5, "Sell", None, None, 0), ("journey", 6, "sell", None, None, 1),
        ("flow", 11, "Pay", "web", None, 0), ("flow", 12, "pay", " Web ", None, 1), ("flow", 13, "Pay", None, None, 1), ("page", 21, "Cart", None, None, 0),
    ]
    links = [("flow", 11, 1), ("flow", 12, 2), ("flow", 12, 3), ("flow", 13, 6), ("page", 21, 11), ("page", 21, 12), ("page", 21, 12), ("page", 21, 99)]
    return spark.createDataFrame(nodes, "label string, id long, name string, platform string, scenario_id long, seq int"), spark.createDataFrame(links, "label string, child long, parent long")


def test_design_graph_merges_and_is_idempotent(spark):
    nodes, links = _graph(spark)
    merged, moved = merges.merge_design_graph(nodes, links)
    got = {(r.label, r.id): (r.name, r.scenario_id, r.parent_ids) for r in merged.collect()}
    assert got == {
        ("journey", 1): ("buy ", 7, []), ("journey", 3): ("Buy", 8, []), ("journey", 5): ("sell", None, []), ("flow", 11): ("pay", None, [1, 3]), ("flow", 13): ("Pay", None, [5]), ("page", 21): ("Cart", None, [11, 99]),
    }
    again, links2 = merges.merge_design_graph(merged.selectExpr("label", "id", "name", "platform", "scenario_id", "0 AS seq"), moved)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect())) and sorted(map(tuple, links2.collect())) == sorted(map(tuple, moved.collect()))


def test_deletes_leave_no_dangling_id(spark):
    links = spark.createDataFrame([("flow", 11, 1), ("flow", 11, 2), ("flow", 12, 1), ("page", 21, 12), ("page", 22, 11), ("page", 22, 12), ("component", 31, 21), ("component", 32, 21), ("component", 32, 22)], "label string, child long, parent long")
    gone, kept = merges.delete_design(spark.createDataFrame([(1,)], "id long"), links, merges.DESIGN[1:])
    assert sorted(map(tuple, gone.collect())) == [("component", 31), ("flow", 12), ("page", 21)]
    assert {(r.label, r.child): r.parent_ids for r in merges.parent_arrays(kept).collect()} == {("flow", 11): [2], ("page", 22): [11], ("component", 32): [22]}


def test_architecture_shows_what_sources_say(spark):
    rows = [("Services", "Api", "doc", "By hand", ["sales"], "java", None, "vm"), ("Services", "API", "code", "From code", ["billing", "sales"], "kotlin", "eu", None), ("Services", "api", "iac", None, None, "jvm", "us", "k8s"), ("DataLake", "s3", "iac", None, None, None, "us", None)]
    merged, differ = merges.merge_architecture(spark.createDataFrame(rows, "layer string, name string, source string, description string, domain array<string>, technology string, region string, deployment string"))
    api = merged.where("layer = 'Services'").first()
    assert (api["name"], api.description, api.domain, api.technology, api.region, api.deployment, api.domains, api.origin) == ("Api", "By hand", "sales", "jvm", "us", "k8s", "billing,sales", "documented")
    assert merged.where("layer = 'DataLake'").first().origin == "iac-discovered"
    assert {(r.field, r.value, r.sources, r.chosen) for r in differ.where("field IN ('region', 'domain', 'name')").collect()} == {("region", "us", "iac", True), ("region", "eu", "code", False), ("domain", "sales", "doc", True), ("domain", "billing,sales", "code", False), ("name", "Api", "doc", True), ("name", "API", "code", False), ("name", "api", "iac", False)}


def test_audit_counts_and_reasons(spark):
    disk = spark.createDataFrame([("r", "a.ts", 10, 2, 1), ("r", "dist/b.ts", 5, 1, 0), ("r", "c.md", 3, 0, 0), ("r", "d.ts", 1, 1, 1)], "repo string, path string, loc long, functions long, classes long")
    indexed = spark.createDataFrame([("r", "a.ts", 9), ("s", "x.ts", 4)], "repo string, path string, loc long")
    got = {r.repo: r for r in repos.coverage_audit(indexed, disk).collect()}
    assert (got["r"].files_delta, got["r"].loc_delta, got["r"].functions_indexed, got["r"].functions_disk, got["r"].functions_delta, got["s"].files_delta) == (-3, -10, None, 4, None, 1)
    assert {r.path: r.reason for r in repos.unindexed_reasons(disk, indexed).collect()} == {"dist/b.ts": "excluded", "c.md": "unsupported", "d.ts": "missing"}
