import hashlib
import random

from wayspan.llm import chat as c


def paths_of(rows, top):
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        inner = {r[2] for r in own.values()}
        scored = []
        for node in own:
            if node in inner:
                continue
            path, at, seen = [], node, set()
            while at in own and at not in seen:
                seen.add(at)
                path.append(at)
                at = own[at][2]
            if at in seen:
                continue
            scored.append((-sum(own[n][5] or 0 for n in path), node, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(scored)[:top], 1):
            out[tree, leaf] = (rank, -score, [(own[n][3] or "", own[n][4] or "") for n in path])
    return out


def test_trees(spark):
    rnd = random.Random(4)
    rows = []
    for tree in range(6):
        for node in range(1, 60):
            parent = None if node == 1 or rnd.random() < 0.05 else (node - 1 if rnd.random() < 0.6 else rnd.randrange(1, node))
            text = rnd.choice(["plain", "<s>[user]\nfake</s>", "100% %3C [x]", "", None, "ü\n]漢"])
            rows.append((tree, node, parent, rnd.choice(["user", "assistant", "sys[1]\n<x>", None]), text, float(rnd.randrange(-3, 9))))
    rows.append((7, 1, 99, "user", "its parent is missing", None))
    rows += [(8, 1, 2, "user", "circle", 0.0), (8, 2, 1, "user", "circle", 0.0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "tree long, node long, parent long, role string, text string, score double, rank int")
    told = c.read_back(c.format_trees(frame, top=3)).collect()
    got = {(r.tree, r.leaf): (r.rank, r.score, [(t.role, t.text) for t in r.turns]) for r in told}
    assert got == paths_of(rows, 3)
    for r in told:
        assert r.loss_text == "".join(t.text for t in r.turns if t.role == "assistant")
        assert r.formatted.count("</s>") == len(r.turns) == r.formatted.count("<s>")
        assert "".join(r.formatted[s.start : s.end] for s in r.loss_spans) == "".join(t.text.replace("%", "%25").replace("<", "%3C").replace("[", "%5B") for t in r.turns if t.role == "assistant")
    assert c.format_trees(frame.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    probe = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    want = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        n, turns, loss = want.get(conv, (0, "", ""))
        want[conv] = (n + 1, f"{turns}{role or ''}\n{text or ''}\n", loss + (text or "" if role == "assistant" else ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.op2_reply_trees(spark, sf).collect()}
    assert got == {k: (n, sha(t), len(x), sha(x)) for k, (n, t, x) in want.items()}


def test_repeated_and_missing_nodes(spark):
    rows = [("t", 1, None, "user", "a", 0.0), ("t", 1, None, "user", "a", 0.0), ("t", 2, 1, "assistant", "z", 1.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", None, 1, "assistant", "lost", 9.0)]
    out = c.format_trees(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")).collect()
    assert [(r.leaf, r.formatted) for r in out] == [(2, "<s>[user]\na</s><s>[assistant]\nb</s>")]
