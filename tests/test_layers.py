from millrace.operators.layers import CAPS, architecture, main_modules

ENTITIES = "id string, kind string, name string, key string, repo string"


def drawn(spark, entities, edges, repos=(("a", "org/a"), ("b", "org/b"), ("c", "org/c"))):
    nodes, links = architecture(spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(edges, "src string, dst string, kind string, repo string"), spark.createDataFrame(list(repos), "repo string, name string"))
    boxes = {}
    for r in nodes.orderBy("repo", "layer", "place").collect():
        boxes.setdefault((r.repo, r.layer), []).append((r.node, r["size"]))
    return boxes, {(r.repo, r.src, r.dst, r.kind): r.weight for r in links.collect()}


def test_layers_of_a_service(spark):
    entities = [
        ("s", "service", "cart", "cart", None), ("e1", "endpoint", "GET /api/v1/orders", "", "a"), ("e2", "endpoint", "POST /orders/{id}", "", "a"), ("f", "symbol", "pay", "", "a"), ("t", "queue_topic", "paid", "", None), ("d", "datastore", "pg", "", None),
        ("x", "symbol", "other", "", "b"), ("r", "dependency", "react", "npm:react", None), ("v", "dependency", "vue", "npm:vue", None), ("m1", "module", "", "a:src", "a"), ("m2", "module", "", "a:src/core", "a"), ("m3", "module", "", "a:src/tests", "a"), ("o", "external_api", "stripe", "", None),
    ]
    edges = [
        ("ra", "s", "deployed_as", "a"), ("f", "t", "publishes", "a"), ("s", "t", "subscribes", "a"), ("f", "d", "uses", "a"), ("x", "e1", "calls", "b"), ("x", "e1", "calls", "b"), ("f", "x", "calls", "a"), ("f", "r", "depends_on", "a"), ("f", "v", "depends_on", "a"), ("f", "o", "calls", "a"), ("f", "d", "reads_env", "a"), ("x", "t", "subscribes", "b"),
    ]
    boxes, links = drawn(spark, entities, edges)
    own = {layer: boxes.get(("a", layer), []) for layer in CAPS}
    assert own == {"upstream": [("repo:b", 0)], "interface": [("api:/orders", 2)], "core": [("s", 2), ("m2", 0)], "messaging": [("t", 3)], "data": [("d", 2)], "downstream": [("deps:npm", 2), ("o", 1)]}
    assert {k[1:]: v for k, v in links.items() if k[0] == "a"} == {
        ("s", "t", "publishes"): 1, ("t", "s", "subscribes"): 1, ("s", "d", "uses"): 1, ("repo:b", "api:/orders", "calls"): 2, ("s", "deps:npm", "depends_on"): 2, ("s", "o", "calls"): 1, ("s", "m2", "contains"): 1, ("s", "api:/orders", "exposes"): 2, ("s", "repo:b", "calls"): 1,
    }
    # without a service a repository stands for itself; without edges, alone
    assert boxes["b", "core"] == [("repo:b", 0)] and boxes["c", "core"] == [("repo:c", 0)] and links["b", "repo:b", "repo:a", "calls"] == 2 and boxes["b", "messaging"] == [("t", 3)]


def test_caps_and_others(spark):
    topics = [(f"t{i:02d}", "queue_topic", f"topic {i:02d}", "", None) for i in range(20)]
    edges = [("f", t[0], "publishes", "a") for t in topics] + [("f", "t19", "reads", "a")]
    boxes, links = drawn(spark, [("f", "symbol", "f", "", "a"), *topics], edges)
    own = boxes["a", "messaging"]
    assert own[0] == ("t19", 2) and [n for n, _ in own[1:12]] == [f"t{i:02d}" for i in range(11)] and own[12:] == [("others:messaging", 8)]
    assert len([k for k in links if k[0] == "a"]) == 13


def test_modules(spark):
    rows = [("1", "module", "", "a:lib", "a"), ("2", "module", "", "a:lib/x", "a"), ("3", "module", "", "a:lib/x/mock", "a"), ("4", "module", "tools", "tools", "a"), ("5", "module", "", "b:lib", "b"), ("6", "symbol", "lib", "", "a")]
    assert {r.id for r in main_modules(spark.createDataFrame(rows, ENTITIES)).collect()} == {"2", "4", "5"}
