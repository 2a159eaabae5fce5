"""Iterative and corpus operators against brute force."""

import random
import re
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from tracefold import rules
from tracefold.operators import graph, intel, lineage, tokens
from tracefold.sources import graphs as graph_io
from tracefold.sources import store

NODES = "graph_id bigint, id bigint, type string, name string"
EDGES = "graph_id bigint, src bigint, dst bigint, etype string"


def test_bfs_with_cycles_and_missing_parts(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 3), (5, 6)]
    edges = spark.createDataFrame([(1, a, b, "CALLS") for a, b in pairs], EDGES)
    start = spark.createDataFrame([(1, 0), (1, 9)], "graph_id bigint, id bigint")
    got = {r["id"]: r["distance"] for r in graph.bfs_reach(edges, start).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}


def brute_reaching(defs, uses, preds):
    found = set()
    for block, var in uses:
        seen, queue = set(), deque(preds.get(block, ()))
        while queue:
            at = queue.popleft()
            if at in seen:
                continue
            seen.add(at)
            if (at, var) in defs:
                found.add((var, at, block))
            else:
                queue.extend(preds.get(at, ()))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_reaching_definitions(spark, seed):
    random.seed(seed)
    blocks, variables = range(12), "abc"
    defs = {(b, v) for b in blocks for v in variables if random.random() < 0.25}
    uses = {(b, v) for b in blocks for v in variables if random.random() < 0.5}
    preds = {b: {random.choice(blocks) for _ in range(2)} for b in blocks}
    table = spark.createDataFrame(
        [(0, "f", b, v, (b, v) in defs, (b, v) in uses) for b in blocks for v in variables],
        "graph_id bigint, func string, block_id bigint, var string, is_defined boolean, "
        "is_exposed boolean")
    back = spark.createDataFrame([(0, "f", b, p) for b, ps in preds.items() for p in ps],
                                 "graph_id bigint, func string, block_id bigint, pred_id bigint")
    got = {(r["var"], r["def_id"], r["use_id"])
           for r in graph.reaching_definitions(table, back).collect()}
    assert got == brute_reaching(defs, uses, preds)


def test_block_zero_counts_as_absent(spark):
    nodes = spark.createDataFrame([(1, i, "BLOCK", "") for i in range(3)], NODES)
    edges = spark.createDataFrame([(1, 0, 1, rules.EDGE_CFG), (1, 1, 2, rules.EDGE_CFG)], EDGES)
    placed = graph.instruction_to_block(nodes, edges)
    count = lambda flag: graph.collapse_to_blocks(nodes, edges, placed, flag).count()
    assert (count(True), count(False)) == (1, 2)


def test_every_node_is_ranked(spark):
    nodes = [(1, i, "METHOD" if i < 2 else "BLOCK", "") for i in range(20)]
    nodes += [(2, i, "BLOCK", "") for i in range(3)]
    edges = [(1, 0, 19, rules.EDGE_CFG), (1, 19, 18, rules.EDGE_CFG)]
    got = {(r["graph_id"], r["id"]): r["place"] for r in graph.rank_nodes(
        spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect()}
    assert len(got) == 23
    assert [k for k in sorted(got, key=lambda k: (k[0], got[k]))][:5] == [
        (1, 0), (1, 1), (1, 19), (1, 18), (1, 2)]


def brute_expand(roots, members):
    children = {}
    for container, seq, item, digest, is_container in sorted(members, key=lambda m: m[1]):
        children.setdefault(container, []).append((item, digest, is_container))
    out = {}
    for root, item, digest, is_container in roots:
        queue, seen, taken = deque([(item, digest, is_container, 0)]), set(), 0
        while queue:
            item, digest, is_container, depth = queue.popleft()
            taken += 1
            if digest in seen:
                continue
            seen.add(digest)
            out.setdefault(root, []).append((item, depth))
            if is_container:
                queue.extend((*c, depth + 1) for c in children.get(item, ()))
        out.setdefault(root, []).append(("taken", taken))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_expand_containers(spark, seed):
    random.seed(seed)
    members = [(random.randrange(i), i, i, f"h{random.randrange(150)}", random.random() < 0.8)
               for i in range(1, 200)]
    roots = [(r, r, f"root{r}", True) for r in (0, 1, 2)]
    got = {}
    rows = lineage.expand_containers(
        spark.createDataFrame(roots, "root_id bigint, item_id bigint, hash string, "
                                     "is_container boolean"),
        spark.createDataFrame(members, "container_id bigint, member_seq bigint, item_id bigint, "
                                       "hash string, is_container boolean")).collect()
    for r in sorted(rows, key=lambda r: (r["root_id"], r["position"])):
        got.setdefault(r["root_id"], []).append((r["item_id"], r["depth"]))
    for root in got:
        total = {r["total_processed"] for r in rows if r["root_id"] == root}
        got[root].append(("taken", total.pop()))
    assert got == brute_expand(roots, members)


def test_upsert_replays_inserts(spark):
    random.seed(3)
    rows = [(f"i{random.randrange(30)}", f"h{random.randrange(30)}", n) for n in range(200)]
    kept = []
    for row in rows:
        kept = [k for k in kept if k[0] != row[0] and k[1] != row[1]] + [row]
    df = lambda part: spark.createDataFrame(part, "id string, file_hash string, created_at int")
    got = store.upsert_analyses(df([]), df(rows)).collect()
    assert {tuple(r) for r in got} == set(kept)


# --- sub-words ------------------------------------------------------------------------

TEXTS = ["getFileName", "get_file__size", "HTTPServer2", "—", "parseXMLFile", "x_1_getName",
         "FILENAME", "fileName fileSize", ""]


def words_of(text):
    out = []
    for part in re.split("_+", text):
        runs = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+", part)
        out += runs or [part]
    return [w.lower() for w in out if w]


def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "text_id int, text string")


def test_split_identifier(spark):
    got = table(spark).select("text_id", tokens.split_identifier(F.col("text")).alias("w"))
    assert {r["text_id"]: r["w"] for r in got.collect()} == {
        i: words_of(t) for i, t in enumerate(TEXTS)}


def brute_merges(count):
    words = Counter(" ".join(w) + " </w>" for t in TEXTS for w in words_of(t))
    merges = []
    for _ in range(count):
        pairs = Counter()
        for word, freq in words.items():
            parts = word.split()
            for pair in zip(parts, parts[1:]):
                pairs[pair] += freq
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        words = Counter({w.replace(" ".join(best), "".join(best)): f for w, f in words.items()})
    return merges


def test_bpe_round_trip(spark):
    merges = tokens.bpe_train(table(spark), 15, cut_every=4)
    learned = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    assert learned == brute_merges(15)
    vocab = tokens.bpe_vocab(merges)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    want = {}
    for i, text in enumerate(TEXTS):
        out = []
        for word in words_of(text):
            spaced = " ".join(word) + " </w>"
            for a, b in learned:
                spaced = spaced.replace(f"{a} {b}", a + b)
            for token in spaced.split():
                out += [ids[token]] if token in ids else [ids.get(c, 1) for c in token]
        if out:
            want[i] = out
    encoded = tokens.bpe_encode(table(spark), merges, vocab)
    assert {r["text_id"]: r["token_ids"] for r in encoded.collect()} == want
    names = {v: k for k, v in ids.items()}
    decoded = {r["text_id"]: r["text"] for r in tokens.bpe_decode(encoded, vocab).collect()}
    assert decoded == {i: "".join(names[t] for t in ts).replace("</w>", "")
                       for i, ts in want.items()}


def test_api_hash_of_empty_name(spark):
    imports = spark.createDataFrame([(1, 0, "k.dll!"), (1, 1, "K!Ab"), (1, 2, "")],
                                    "file_id bigint, seq bigint, func string")
    got = {(r["file_id"], r["pos"]): r["id"] for r in tokens.hash_api_tokens(imports).collect()}
    def token(name):
        h = 5381
        for c in name:
            h = (h * 33 + ord(c)) % 2**32
        return h % 4095 + 1
    assert got == {(1, 0): token(""), (1, 1): token("ab")}


def test_graph_documents_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, "METHOD", 'a"b'), (1, 1, "BLOCK", ""), (2, 0, "CALL", "é")],
                                  NODES)
    edges = spark.createDataFrame([(1, 0, 1, rules.EDGE_CFG)], EDGES)
    records = graph_io.graph_records(nodes, edges)
    assert all("signature" not in r["json"] for r in records.collect())
    graph_io.graph_write(records, str(tmp_path / "g"))
    for source in (graph_io.read_records(spark, str(tmp_path / "g")),
                   graph_io.parse_documents(graph_io.graph_documents(records))):
        got_nodes, got_edges = graph_io.graph_read(source)
        assert {tuple(r) for r in got_nodes.select(*nodes.columns).collect()} == {
            tuple(r) for r in nodes.collect()}
        assert [tuple(r) for r in got_edges.select(*edges.columns).collect()] == [
            (1, 0, 1, rules.EDGE_CFG)]


def test_graph_documents_hold_graphs_of_any_size(spark):
    n = 60_000
    nodes = spark.range(n).selectExpr("1L AS graph_id", "id", "'BLOCK' AS type", "'' AS name")
    edges = spark.range(n).selectExpr("1L AS graph_id", "id AS src", "0L AS dst", "'CFG' AS etype")
    documents = graph_io.graph_documents(graph_io.graph_records(nodes, edges))
    got = graph_io.parse_documents(documents).groupBy("graph_id", "part").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, "edge", n), (1, "node", n)]


def test_graph_document_pieces(spark):
    nodes = spark.createDataFrame([(1, i, "BLOCK", "n" * (i % 7)) for i in range(300)] + [(None, 1, "CALL", "x" * 900)],
                                  NODES)
    edges = spark.createDataFrame([(1, 0, 1, rules.EDGE_CFG)] * 40, EDGES)
    graphs = spark.createDataFrame([(1, "f", "exe", {"k": "v"})],
                                   "graph_id bigint, source_file string, file_type string, metadata map<string,string>")
    records = graph_io.graph_records(nodes, edges, graphs)
    pieces = graph_io.graph_documents(records, piece_bytes=400).collect()
    longest = max(len(r["json"]) for r in records.collect())
    assert all(len(r["document"]) <= 400 + longest + 2 for r in pieces)
    assert len({(r["graph_id"], r["part"], r["piece"]) for r in pieces}) == len(pieces) > 20
    ordered = [r["document"] for r in sorted((r for r in pieces if (r["graph_id"], r["part"]) == (1, "node")),
                                             key=lambda r: r["piece"])]
    assert ordered == sorted(ordered)
    back = graph_io.parse_documents(graph_io.graph_documents(records, piece_bytes=400))
    assert sorted((r["graph_id"] or 0, r["part"], r["json"]) for r in back.collect()) == sorted(
        (r["graph_id"] or 0, r["part"], r["json"]) for r in records.collect())


def test_orphan_indicators_vanish_from_search(spark):
    iocs = spark.createDataFrame([("a", "ip", "v", "c"), ("gone", "ip", "v", "c")],
                                 "analysis_id string, ioc_type string, ioc_value string, context string")
    analyses = spark.createDataFrame([("a", "f", "BENIGN", 1.0)],
                                     "id string, file_name string, verdict string, risk_score double")
    assert [r["id"] for r in intel.search_ioc(iocs, analyses, "v").collect()] == ["a"]


def test_a_round_shuffles_the_frontier_only(spark):
    from tracefold.session import cut_bucketed, without
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ids = spark.range(2000).selectExpr("id % 3 AS graph_id", "id")
        links = cut_bucketed(ids.selectExpr("graph_id", "id", "(id * 7) % 2000 AS next"), graph.NODE)
        frontier = cut_bucketed(ids.where("id < 900"), graph.NODE)
        step = without(graph.reached_next(links, frontier), [frontier, cut_bucketed(ids.where("id > 1500"), graph.NODE)],
                       graph.NODE)
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 4
    assert {tuple(r) for r in step.collect()} == {
        (i % 3, i * 7 % 2000) for i in range(900)
        if not (i * 7 % 2000 < 900 and i * 7 % 2000 % 3 == i % 3) and not (i * 7 % 2000 > 1500 and i * 7 % 2000 % 3 == i % 3)}
