import itertools
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.operators.networks import backbone, build, filters, iterative, job, metrics, searches, style
from mapweave.operators.networks.graph import Graph
from mapweave.operators.networks.overlap import QueryOverlap
from mapweave.sources import exports, gexf


def make(spark, edges, extra_nodes=(), directed=False, types=None):
    names = sorted({n for e in edges for n in e[:2]} | set(extra_nodes))
    nodes = spark.createDataFrame(
        [(n, (types or {}).get(n, "website"), n.upper()) for n in names], "node_id string, node_type string, label string")
    rows = [(e[0], e[1], float(e[2]) if len(e) > 2 else 1.0) for e in edges]
    return Graph(nodes, spark.createDataFrame(rows, "src string, dst string, weight double"), directed)


RING_AND_TAIL = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")]


def distances(names, edges):
    near = {n: [] for n in names}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out = {}
    for s in names:
        d, paths, queue = {s: 0}, {s: 1}, deque([s])
        while queue:
            u = queue.popleft()
            for v in near[u]:
                if v not in d:
                    d[v], paths[v] = d[u] + 1, 0
                    queue.append(v)
                if d[v] == d[u] + 1:
                    paths[v] += paths[u]
        out[s] = (d, paths)
    return out


def test_disparity_filter_star(spark):
    graph = make(spark, [("c", "l1", 10), ("c", "l2", 1), ("c", "l3", 1)], extra_nodes=["lonely"])
    cut = backbone.disparity_filter(graph, 0.05)
    assert [(r["src"], r["dst"]) for r in cut.edges.collect()] == [("c", "l1")]
    assert {r["node_id"] for r in cut.nodes.collect()} == {"c", "l1"}
    alphas = {r["dst"]: r["alpha_src"] for r in backbone.edge_significance(graph).collect()}
    assert alphas["l1"] == pytest.approx((1 - 10 / 12) ** 2)
    assert alphas["l2"] == pytest.approx((11 / 12) ** 2)
    stats = backbone.retention(graph, cut, "disparity_filter").first()
    assert (stats["original_nodes"], stats["backbone_nodes"], stats["edges_removed"]) == (5, 2, 2)


def test_backbone_grows_with_alpha_and_needs_both_ends(spark):
    rng = np.random.default_rng(1)
    edges = [(f"q{a}", f"s{b}", float(rng.integers(1, 40))) for a in range(12) for b in range(15) if rng.random() < 0.6]
    graph = make(spark, edges)
    strength, degree = {}, {}
    for a, b, w in edges:
        for n in (a, b):
            strength[n] = strength.get(n, 0) + w
            degree[n] = degree.get(n, 0) + 1

    def alpha(n, w):
        return 0.0 if degree[n] == 1 else (1 - w / strength[n]) ** (degree[n] - 1)

    sizes = []
    for level in (0.05, 0.2, 0.5):
        expected = {(a, b) for a, b, w in edges if alpha(a, w) < level and alpha(b, w) < level}
        got = {(r["src"], r["dst"]) for r in backbone.disparity_filter(graph, level).edges.collect()}
        assert got == expected
        sizes.append(len(got))
    assert sizes == sorted(sizes)


def test_directed_filter_and_dispatch(spark):
    graph = make(spark, [("a", "b", 9), ("a", "c", 1), ("b", "c", 1)], directed=True)
    kept = backbone.disparity_filter(graph, 0.2).edges.collect()
    assert {(r["src"], r["dst"]) for r in kept} == {("a", "b"), ("b", "c")}
    assert backbone.apply_backbone(graph, "threshold", threshold=2).edges.count() == 1
    assert backbone.apply_backbone(graph, "top_k", k=2).edges.count() == 2
    for bad in ({"algorithm": "threshold"}, {"algorithm": "top_k"}, {"algorithm": "other"}):
        with pytest.raises(ValueError):
            backbone.apply_backbone(graph, **bad)


def test_repeated_site_keeps_the_worst_rank(spark):
    queries = spark.createDataFrame([(1, 1, "q", "completed"), (2, 1, "p", "failed")],
                                    "query_id bigint, session_id bigint, query_text string, status string")
    results = spark.createDataFrame(
        [(10, 1, 2, "d.com", "https://d.com/1", "first"), (11, 1, 5, "d.com", "https://d.com/2", "second"),
         (12, 2, 1, "z.com", "https://z.com/", "other")],
        "result_id bigint, query_id bigint, rank bigint, domain string, url string, title string")
    graph = build.query_website_network(queries.withColumn("search_engine", F.lit("x")), results)
    edge = graph.edges.collect()
    assert [(e["src"], e["dst"], e["weight"], e["rank"], e["n_results"]) for e in edge] == [
        ("query_1", "website_d.com", 0.2, 5, 2)]
    assert graph.nodes.filter("node_type = 'website'").first()["title"] == "first"
    custom = build.query_website_network(queries, results, weight=lambda r: r * 2.0).edges.first()
    assert custom["weight"] == 10.0


@pytest.mark.parametrize("edges", [
    RING_AND_TAIL,
    [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)],
    [("hub", f"leaf{i:02d}") for i in range(60)] + [("p", "q")],
])
def test_components(spark, edges):
    graph = make(spark, edges, extra_nodes=["alone"])
    got = {r["node_id"]: r["component"] for r in iterative.connected_components(graph).collect()}
    names = list(got)
    reach = distances(names, [e[:2] for e in edges])
    assert got == {n: min(reach[n][0]) for n in names}


def test_components_of_hubs_and_shuffled_chains(spark):
    rng = np.random.default_rng(4)
    order = [f"c{i:04d}" for i in rng.permutation(400)]
    chain = list(zip(order, order[1:], strict=False))
    edges = chain + [("hub", f"leaf{i:04d}") for i in range(1500)] + [("leaf0003", order[200]), ("x", "x")]
    got = {r["node_id"]: r["component"] for r in iterative.connected_components(make(spark, edges)).collect()}
    assert got.pop("x") == "x" and set(got.values()) == {"c0000"} and len(got) == 400 + 1501


def test_two_coloring(spark):
    assert not iterative.is_two_colorable(make(spark, RING_AND_TAIL))
    assert iterative.is_two_colorable(make(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]))


def test_closeness_and_betweenness_against_brute_force(spark):
    edges = RING_AND_TAIL + [("b", "e")]
    graph = make(spark, edges, extra_nodes=["alone"])
    names = [r["node_id"] for r in graph.nodes.collect()]
    n, table = len(names), distances(names, edges)
    near = {r["node_id"]: r["centrality"] for r in iterative.closeness(graph).collect()}
    for v in names:
        d = table[v][0]
        r = len(d) - 1
        assert near[v] == pytest.approx((r / sum(d.values())) * (r / (n - 1)) if r else 0.0)
    between = {r["node_id"]: r["centrality"] for r in iterative.betweenness(graph).collect()}
    for v in names:
        total = 0.0
        for s, t in itertools.permutations([x for x in names if x != v], 2):
            (ds, ps), (dv, pv) = table[s], table[v]
            if t in ds and v in ds and t in dv and ds[v] + dv[t] == ds[t]:
                total += ps[v] * pv[t] / ps[t]
        assert between[v] == pytest.approx(total / ((n - 1) * (n - 2)))


def brute_force(names, edges, directed):
    """Closeness and betweenness by a search from every node."""
    table = {v: [{v: 0}, {v: 1}] for v in names}
    out = {v: [] for v in names}
    for a, b in set(edges):
        out[a].append(b)
        if not directed:
            out[b].append(a)
    for s in names:
        dist, count, layer = table[s][0], table[s][1], [s]
        while layer:
            nxt = []
            for v in layer:
                for w in set(out[v]):
                    if w not in dist:
                        dist[w], count[w] = dist[v] + 1, 0
                        nxt.append(w)
                    if dist[w] == dist[v] + 1:
                        count[w] += count[v]
            layer = nxt
    n, near, between = len(names), {}, dict.fromkeys(names, 0.0)
    for v in names:
        far = [table[s][0][v] for s in names if v in table[s][0] and s != v]
        near[v] = (len(far) / sum(far)) * (len(far) / (n - 1)) if far else 0.0
    for s in names:
        ds, ps = table[s]
        for t in ds:
            for v in ds:
                if len({s, t, v}) == 3 and t in table[v][0] and ds[v] + table[v][0][t] == ds[t]:
                    between[v] += ps[v] * table[v][1][t] / ps[t] / ((n - 1) * (n - 2))
    return near, between


@pytest.mark.parametrize("directed", [False, True])
def test_searches_of_many_sources_in_batches(spark, directed):
    rng = np.random.default_rng(8)
    names = [f"n{i:03d}" for i in range(90)]  # more than the bits of a word
    edges = sorted({(names[a], names[b]) for a, b in rng.integers(0, 80, (110, 2)) if a < b} | {(names[i], names[80]) for i in range(0, 60, 3)})
    graph = make(spark, edges, directed=directed, extra_nodes=names)
    near, between = brute_force(names, edges, directed)
    assert {r["node_id"]: r["centrality"] for r in iterative.closeness(graph, batch=40).collect()} == pytest.approx(near)
    assert {r["node_id"]: r["centrality"] for r in iterative.betweenness(graph, batch=40).collect()} == pytest.approx(between)
    assert {r["node_id"]: r["centrality"] for r in iterative.betweenness(graph, sources=500).collect()} == pytest.approx(between)


def test_sampled_betweenness_is_near(spark):
    rng = np.random.default_rng(3)
    names = [f"n{i:03d}" for i in range(150)]
    edges = sorted({(names[min(a, b)], names[max(a, b)]) for a, b in rng.integers(0, 150, (400, 2)) if a != b})
    between = brute_force(names, edges, False)[1]
    found = {r["node_id"]: r["centrality"] for r in iterative.betweenness(make(spark, edges, extra_nodes=names), sources=75, seed=2).collect()}
    assert max(abs(found[v] - between[v]) for v in names) < 0.1
    assert searches.sources_for(0.1) == 185


def test_eigenvector_against_numpy(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    graph = make(spark, edges)
    names = sorted({n for e in edges for n in e})
    matrix = np.zeros((4, 4))
    for a, b in edges:
        matrix[names.index(a), names.index(b)] = matrix[names.index(b), names.index(a)] = 1
    vector = np.abs(np.linalg.eigh(matrix)[1][:, -1])
    got = {r["node_id"]: r["centrality"] for r in iterative.eigenvector(graph).collect()}
    assert [got[n] for n in names] == pytest.approx(vector / np.linalg.norm(vector), abs=1e-4)
    assert iterative.eigenvector(graph, max_iter=1) is None


def test_strong_components(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a")]
    graph = make(spark, edges, directed=True)
    got = {}
    for r in iterative.strong_components(graph.nodes, graph.edges).collect():
        got.setdefault(r["component"], set()).add(r["node_id"])
    assert sorted(map(sorted, got.values())) == [["a", "b", "c"], ["d", "e"], ["f"]]


def test_clustering_and_projection(spark):
    rows = {r["node_id"]: (r["triangles"], r["clustering"]) for r in metrics.clustering(make(spark, RING_AND_TAIL)).collect()}
    assert rows["a"] == (1, 1.0) and rows["c"] == (1, pytest.approx(1 / 3)) and rows["e"] == (0, 0.0)
    rng = np.random.default_rng(11)
    dense = sorted({(f"v{min(a, b):03d}", f"v{max(a, b):03d}") for a, b in rng.integers(0, 130, (2500, 2)) if a != b})
    near = {}
    for a, b in dense:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {v: sum(len(near[v] & near[w]) for w in near[v]) // 2 for v in near}
    got = metrics.clustering(make(spark, dense, extra_nodes=["lonely"])).collect()
    assert {r["node_id"]: r["triangles"] for r in got} == want | {"lonely": 0}
    assert all(r["clustering"] == pytest.approx(2 * want[r["node_id"]] / (len(near[r["node_id"]]) * (len(near[r["node_id"]]) - 1))) for r in got if r["node_id"] in near)
    types = {"q1": "query", "q2": "query", "s1": "website", "s2": "website", "s3": "website"}
    graph = make(spark, [("q1", "s1"), ("q1", "s2"), ("q2", "s1"), ("q2", "s2"), ("q2", "s3")], types=types)
    for chunk in (1, 2, 2000):
        pairs = {(r["a"], r["b"]): r["weight"] for r in metrics.project(graph, "website", chunk).collect()}
        assert pairs == {("s1", "s2"): 2, ("s1", "s3"): 1, ("s2", "s3"): 1}


@pytest.mark.parametrize("hub_degree", [1, 3, 8, 1000])
def test_query_overlap_is_exact_at_any_hub_limit(spark, hub_degree):
    rng = np.random.default_rng(5)
    sets = {q: {f"s{int(x)}" for x in rng.zipf(1.6, 4) if x < 30} for q in range(40)}
    sets[40] = set()
    sets[41] = set()
    queries = spark.createDataFrame([(q,) for q in sets], "query_id bigint")
    links = spark.createDataFrame([(q, s) for q, ss in sets.items() for s in ss], "query_id bigint, site string")
    found = QueryOverlap(queries, links, hub_degree=hub_degree, top=20)
    scored = []
    for a, b in itertools.combinations(sets, 2):
        union = len(sets[a] | sets[b])
        if union:
            shared = len(sets[a] & sets[b])
            scored.append((-shared, a, b, shared / union))
    row = found.summary().first()
    assert row["total_comparisons"] == len(scored)
    assert row["avg_jaccard"] == pytest.approx(sum(s[3] for s in scored) / len(scored))
    expected = [(a, b, -s, pytest.approx(j)) for s, a, b, j in sorted(scored)[:20]]
    assert [(r["q1"], r["q2"], r["shared"], r["jaccard"]) for r in found.top_pairs().collect()] == expected


def test_weights_sizes_colors_and_validation(spark):
    graph = make(spark, [("a", "b", 2), ("b", "c", 4), ("c", "d", 6)])
    assert sorted(r["weight"] for r in metrics.normalize_weights(graph).edges.collect()) == [0.0, 0.5, 1.0]
    flat = make(spark, [("a", "b", 3), ("c", "d", 3)])
    assert {r["weight"] for r in metrics.normalize_weights(flat).edges.collect()} == {1.0}
    assert {r["size"] for r in style.node_sizes(flat).collect()} == {100.0}
    assert {r["color"] for r in style.node_colors(graph).collect()} == {"#2ecc71"}
    with pytest.raises(ValueError):
        metrics.bipartite_sets(graph)
    typed = make(spark, [("a", "b")], types={"a": "query", "b": "website"})
    assert metrics.is_bipartite_typed(typed, ("query", "website"))
    assert not metrics.is_bipartite_typed(typed, ("query", "keyword"))
    assert not metrics.is_bipartite_typed(graph)


def test_filters(spark):
    graph = make(spark, RING_AND_TAIL, extra_nodes=["alone"])
    assert {r["node_id"] for r in filters.giant_component(graph).nodes.collect()} == set("abcde")
    assert filters.by_label(graph, "X").edges.isEmpty()
    core = filters.by_min_degree(graph, 2)
    assert {r["node_id"] for r in core.nodes.collect()} == set("abcd")
    assert core.edges.count() == 4
    values = {r["metric"]: r["value"] for r in metrics.statistics(
        graph, iterative.component_sizes(iterative.connected_components(graph))).collect()}
    assert values["nodes"] == 8 and values["components"] == 3 and values["largest"] == 5 and values["min_degree"] == 0


@pytest.mark.parametrize("fmt", exports.FORMATS)
def test_export_and_job(spark, tmp_path, fmt):
    graph = make(spark, [("a&<b>", "c\"d", 2), ("e", "f", 1)])
    path = str(tmp_path / fmt)
    row = job.run_network_job(graph, "net", "search_website", [1], path, fmt, algorithm="top_k", k=1).first()
    assert (row["node_count"], row["edge_count"], row["original_edge_count"]) == (2, 1, 2)
    if fmt in ("gexf", "graphml"):
        import xml.etree.ElementTree as et
        from pathlib import Path

        et.parse(path)
        assert [p.name for p in Path(path).parent.iterdir() if "parts-" in p.name] == []
    if fmt == "json":
        import json

        with open(path) as file:
            found = json.load(file)
        assert {n["id"] for n in found["nodes"]} == {"a&<b>", 'c"d'} and [e["weight"] for e in found["links"]] == [2.0]
    if fmt == "gexf":
        back = gexf.read_gexf(spark, path)
        assert {r["node_id"] for r in back.nodes.collect()} == {"a&<b>", 'c"d'}
        assert back.edges.first()["weight"] == 2.0


def test_documents_of_many_parts_are_one_file_in_order(spark, tmp_path):
    from mapweave.sources.documents import write_document

    path = str(tmp_path / "deep" / "numbers.txt")
    for n in (5000, 30, 0):  # a file that is there is replaced
        rows = spark.range(n).repartition(7).orderBy("id").selectExpr("CASE WHEN id = 17 THEN 'é' ELSE CAST(id AS string) END AS line")
        write_document(rows, path)
        with open(path, encoding="utf-8") as file:
            assert file.read().splitlines() == ["é" if i == 17 else str(i) for i in range(n)]


def test_written_graphs_are_read_converted_and_measured(spark, tmp_path):
    edges = [(f"q{i}", f"s{i % 7} & \"x\"", 1 / (i + 1)) for i in range(40)]
    graph = make(spark, edges)
    graph = Graph(graph.nodes.withColumn("domain", F.when(F.col("node_id").startswith("s"), F.col("label"))),
                  graph.edges.withColumn("rank", F.length("src")), directed=True)
    path = str(tmp_path / "g.gexf")
    exports.export_graph(exports.fixed_digits(graph), path, "gexf")
    back = gexf.convert(spark, path, str(tmp_path / "g.json"), "json")
    assert back.directed and dict(back.edges.dtypes)["rank"] == "bigint"
    row = lambda r: (r["src"], r["dst"], r["rank"], pytest.approx(r["weight"], abs=1e-6))
    assert sorted(map(row, back.edges.collect()), key=str) == sorted(map(row, graph.edges.collect()), key=str)
    assert {tuple(r) for r in back.nodes.select("node_id", "node_type", "label", "domain").collect()} == {
        tuple(r) for r in graph.nodes.select("node_id", "node_type", "label", "domain").collect()}
    import json

    with open(tmp_path / "g.json") as file:
        assert len(json.load(file)["links"]) == 40
    one, two = (metrics.quick_statistics(g).first() for g in (graph, back))
    assert one == two


def test_empty_network_is_an_error(spark, tmp_path):
    empty = make(spark, [("a", "b")])
    empty = Graph(empty.nodes.limit(0), empty.edges.limit(0))
    with pytest.raises(ValueError):
        job.run_network_job(empty, "n", "t", [], str(tmp_path / "x"))
    with pytest.raises(ValueError):
        exports.export_graph(empty, str(tmp_path / "y"), "dot")


def test_visual_gexf(spark, tmp_path):
    from pathlib import Path
    import xml.etree.ElementTree as et

    path = str(tmp_path / "viz")
    exports.export_graph(make(spark, [("a", "b"), ("b", "c")]), path, "gexf", visual=True, colors={"website": "#010203"})
    root = et.fromstring(Path(path).read_text())
    space = {"g": "http://www.gexf.net/1.2draft", "v": "http://www.gexf.net/1.2draft/viz"}
    nodes = root.findall(".//g:node", space)
    assert [n.get("id") for n in nodes] == ["a", "b", "c"]
    assert [n.find("v:size", space).get("value") for n in nodes] == ["10.0", "100.0", "10.0"]
    assert nodes[0].find("v:color", space).attrib == {"r": "1", "g": "2", "b": "3"}


def test_rounds_are_written_to_the_configured_folder(spark):
    from pathlib import Path

    from mapweave.session import checkpoint_root, materialize

    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    first = materialize(spark.range(3))
    second = materialize(first.filter("id > 0"), replaces=first)
    assert second.count() == 2
    assert not Path(first._mapweave_path).exists() and Path(second._mapweave_path).exists()


def test_ids_of_nodes_and_edges_are_unique(spark):
    contents = spark.createDataFrame([(1, "a b.org", "u1"), (2, "a/b.org", "u2"), (3, "x" * 300 + "1", "u3"), (4, "x" * 300 + "2", "u4")],
                                     "content_id bigint, domain string, page_url string")
    entities = spark.createDataFrame(
        [(1, "New York", "GPE", 3, 1.0, "m"), (1, "New/York", "GPE", 1, 1.0, "m"), (2, "Oslo", "GPE", 1, 1.0, "m"), (3, "Oslo", "GPE", 1, 1.0, "m"),
         (4, "Oslo", "GPE", 1, 1.0, "m")],
        "content_id bigint, text string, label string, frequency bigint, confidence double, extraction_method string")
    graph = build.website_entity_network(contents, entities, ["GPE"])
    nodes = [r["node_id"] for r in graph.nodes.collect()]
    edges = [(r["src"], r["dst"], r["weight"]) for r in graph.edges.collect()]
    assert len(nodes) == len(set(nodes)) == 5
    assert len({e[:2] for e in edges}) == len(edges) == 4
    assert ("website_a_b.org", "entity_GPE_New_York", 1.0) in edges


def test_gexf_files_are_read_by_ranges(spark, tmp_path):
    """Elements in lines of their own are read by many tasks; files in any other form give the same rows."""
    graph = make(spark, [(f"a{i} <&>\"'", f"b{i % 7}") for i in range(300)])
    path, other = str(tmp_path / "g.gexf"), str(tmp_path / "other.gexf")
    exports.export_graph(graph, path, "gexf", visual=True, colors={"website": "#010203"})
    with open(path) as lines, open(other, "w") as spread:
        spread.write(lines.read().replace("<attvalues>", "\n  <attvalues>").replace("<attribute ", "\n<attribute "))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        back = gexf.read_gexf(spark, path)
        assert back.nodes.rdd.getNumPartitions() > 1 and back.edges.rdd.getNumPartitions() > 1
        slow = gexf.read_gexf(spark, other)
        for near, far in ((back.nodes, slow.nodes), (back.edges, slow.edges)):
            found = sorted(map(str, near.collect()))
            assert found == sorted(map(str, far.collect())) and len(found) >= 300
        assert gexf.declared_attributes(spark, path) == gexf.declared_attributes(spark, other)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
