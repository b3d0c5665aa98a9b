"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import common, components, decontamination, embedding_dedup, html_extract, jaccard_join, packing, queries, secrets, sharding, token_counts, token_output, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, found int, kinds string"
WORD = re.compile("[^ \t-\r]+")


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 0, 0, "") for i, t in zip(ids, texts, strict=True)], DOCS)


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(own, n=5):
    return [tuple(own[i : i + n]) for i in range(len(own) - n + 1)] if len(own) >= n else [tuple(own)] * bool(own)


@pytest.fixture(scope="module")
def given_docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# 1


def test_toxicity_automaton():
    g = toxicity.built_in()
    rule = lambda s: [toxicity.RULES[r] for r, _ in g.clauses(s)]
    assert rule("You idiot. He is not a moron; they said you are scum\nI will kill you") == ["targeted", "negated", "reported", "threat"]
    assert rule("They said: you are scum") == rule("They said you are scum") == ["reported"]
    assert rule('He wrote "you are scum. You idiot!" You moron') == ["reported", "reported", "targeted"]
    assert rule("It is said. You idiot") == ["targeted"] and rule('"You idiot" is rude') == ["targeted"]
    assert rule("kill the lights") == [] and rule("worthless") == ["plain"] and rule("") == []
    assert g.score("you idiot") > g.score("she said you idiot") > g.score("the weather")


def read_clause(classes):
    """The rule of each word of a clause, by the definition: what stands how near before it."""
    out = []
    for i, c in enumerate(classes):
        near = set(classes[max(0, i - toxicity.REACH) : i])
        hit = c == "insult" or (c == "threat" and "intent" in near)
        rule = "negated" if "negation" in near else "reported" if "report" in classes[:i] else "threat" if c == "threat" else "targeted" if "target" in near else "plain"
        out.append(rule if hit else None)
    return out


@settings(max_examples=200, deadline=None)
@given(classes=st.lists(st.sampled_from(toxicity.SYMBOLS), max_size=12))
def test_composition(classes):
    a, state, found = toxicity.compose(), 0, []
    for c in classes:
        i = toxicity.SYMBOLS.index(c)
        found.append(toxicity.RULES[a.rule[state][i]] if a.rule[state][i] >= 0 else None)
        state = a.next[state][i]
    assert found == read_clause(classes)


def test_toxicity_scores(spark):
    """Every score of the query is the grammar's own of that text, with terms counted from the labels by brute force."""
    sf = "/root/testdata/sf0.001"
    own, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.fit(own, labels)
    text = {r["doc_id"]: r["text"] for r in own.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in text}
    bad, good = Counter(), Counter()
    for i, t in toxic.items():
        (bad if t == 1 else good).update(set(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", text[i].lower())))
    n_bad, n_good = sum(t == 1 for t in toxic.values()), sum(t != 1 for t in toxic.values())
    lift = {w: (bad[w] + 0.5) / (n_bad + 1) * (n_good + 1) / (good[w] + 0.5) for w in bad}
    terms = {w: np.log(v) for w, v in lift.items() if v >= toxicity.LIFT and bad[w] >= toxicity.SUPPORT}
    learnt = {w: v for w, (_, v) in grammar.terms.items() if v not in (0.0, toxicity.BUILT_IN)}
    assert learnt.keys() <= terms.keys() and all(abs(learnt[w] - terms[w]) < 1e-9 for w in learnt) and len(learnt) == len(terms)
    found = queries.op1_toxicity(spark, sf).collect()
    assert len(found) == len(text) and all(abs(r["score"] - grammar.score(text[r["doc_id"]])) < 1e-12 for r in found)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in found if r["toxic"] == 1]
    assert np.mean([r["predicted"] == r["toxic"] for r in found]) > 0.93 and np.mean(toxic) > 0.7
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)


def test_toxicity_odd_inputs(spark):
    own = docs(spark, [None, "", "you idiot", "you idiot", "x " * 100_000, "fine"], [None, 1, 2, 2, 3, 4])
    labels = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, toxic int")
    grammar = toxicity.fit(own, labels)
    assert grammar.weights == toxicity.PRIOR.tolist()
    found = toxicity.score(own, grammar).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.rejects(own, grammar).columns == own.columns
    assert toxicity.score(own.limit(0), grammar).count() == 0


# 2


def test_sharding(spark):
    names = [f"n{i}" for i in range(7)]
    owner = sharding.fill(names, 1009)
    share = Counter(owner)
    assert len(owner) == 1009 and max(share.values()) - min(share.values()) <= 1
    # by the definition: turn by turn, the first free slot in each one's order
    taken, at = {}, dict.fromkeys(range(7), 0)
    order = [[(sharding._hash(f"offset {s}") + j * (sharding._hash(f"step {s}") % 1008 + 1)) % 1009 for j in range(1009)] for s in names]
    while len(taken) < 1009:
        for i in range(7):
            free = next((s for s in order[i] if s not in taken), None)
            if free is not None:
                taken[free] = i
    assert [taken[s] for s in range(1009)] == owner
    assert sharding.moved(names, names[:-1], 1009) < 0.2
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)


def test_shard_placement(spark, tmp_path):
    own = docs(spark, ["a", "b", "c", "d"], [None, 1, 1, 2])
    found = sharding.place(own).select("doc_id", "slot", "shard").collect()
    assert len(found) == 4 and len({r["shard"] for r in found if r["doc_id"] == 1}) == 1
    assert sharding.place(own.limit(0)).count() == 0
    everything = queries.op2_sharding(spark, SF).collect()
    table = sharding.fill([f"shard-{i}" for i in range(sharding.SHARDS)])
    assert all(table[r["slot"]] == r["shard"] for r in everything)
    sharding.write_shards(own, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 4


# 3, 6, 9: tokens


@pytest.mark.parametrize("name", [packing.VOCABULARY, token_output.VOCABULARY])
@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.lists(st.one_of(st.text(alphabet=st.sampled_from(list("ab É\n.,!'s1́ß\t 日Z<|>_-\u3000")), max_size=30), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " <|endoftext|> ", "<|endof", "text|>"])), max_size=4).map("".join), max_size=8))
def test_units_are_whole_texts(name, texts):
    library = Tokenizer.from_file(tokens.tokenizer_path(name))  # as it is
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    found = [ids[at[i] : at[i + 1]].tolist() for lo, hi, ids, at in tokens.encoder(tokens.tokenizer_path(name)).encode(pa.array(texts, pa.string())) for i in range(hi - lo)]
    assert found == wanted


def test_added_tokens_in_texts(spark):
    text = "hello <|endoftext|> world"
    own = docs(spark, [text, "plain"], [1, 2])
    for name, last, run in ((packing.VOCABULARY, 0, packing.pack), (token_output.VOCABULARY, 2, token_output.token_output)):
        ids = [*Tokenizer.from_file(tokens.tokenizer_path(name)).encode(text, add_special_tokens=False).ids, last]
        r = run(own).where("doc_id = 1").first()
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert ids[1] == 49407


def best_fit(lengths, size):
    rooms, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if not fits:
            rooms.append(size)
            fits = [(size, len(rooms) - 1)]
        _, i = min(fits)
        rooms[i] -= n
        out.append(n)
    return sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 32), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    rooms = {}
    for n, a, b, window, per, offset in packing.plan(Counter(lengths), 32):
        for k in range(b - a):
            w = window + k // per
            assert rooms.get(w, 32) == 32 - offset - k % per * n
            rooms[w] = rooms.get(w, 32) - n
    assert sorted(rooms.values()) == best_fit(lengths, 32)
    assert sorted(rooms) == list(range(len(rooms)))


def test_packing(spark, given_docs):
    coder = Tokenizer.from_file(tokens.tokenizer_path(packing.VOCABULARY))
    packed = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), with_ids=True)
    rows, used = packed.collect(), defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in given_docs.items():
        ids = np.array(coder.encode(text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            raw = ids[at : at + r["length"]].tobytes()
            assert (r["start"], r["ids_crc32"], bytes(r["ids"]), r["doc_tokens"]) == (at, zlib.crc32(raw), raw, len(ids))
            at += r["length"]
        assert at == len(ids)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(used) == list(range(len(used)))
    whole = packing.sequences(packed).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in rows)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)


def test_packing_odd_inputs(spark):
    own = docs(spark, [None, "", "a b", "a b", "long text " * 3000], [None, 1, 2, 2, 3])
    found = packing.pack(own).collect()
    assert sorted(r["length"] for r in found if r["doc_id"] != 3)[:2] == [1, 1]
    assert Counter(r["doc_id"] for r in found)[2] == 2
    assert packing.pack(own.limit(0)).count() == 0


def test_token_output(spark, given_docs):
    coder = Tokenizer.from_file(tokens.tokenizer_path(token_output.VOCABULARY))
    found = {r["doc_id"]: r for r in queries.op6_token_output(spark, SF).collect()}
    start = 0
    for i in sorted(given_docs):
        ids = np.array(coder.encode(given_docs[i], add_special_tokens=False).ids + [2], "<u4")
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(given_docs)


def test_token_output_odd_inputs(spark, tmp_path):
    own = docs(spark, [None, "b", "a", "a", "z " * 400, "", None], [None, 7, 7, 7, 3, -5, None])
    at = token_output.write(own, str(tmp_path / "t"), block_ids=3)  # blocks of a document or two, so that equal keys span them
    found = token_output.digests(spark, at).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, None, -5, 3, 7, 7, 7]
    assert [r["n_tokens"] for r in found][:3] == [1, 1, 1] and found[-1]["start"] == sum(r["n_tokens"] for r in found[:-1])
    asked = spark.createDataFrame([(7,), (3,), (4,), (None,), (3,)], "doc_id long")
    got = {r["doc_id"]: list(r["ids"]) for r in token_output.lookup(spark, at, asked).collect()}
    assert set(got) == {3, 7} and len(got[3]) == 401
    assert token_output.token_output(own.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(keys=st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300, unique=True))
def test_perfect_hash(keys):
    own = token_output.key_hash(np.array(keys, np.int64), np.zeros(len(keys), np.int64))
    moves = token_output.perfect_hash(own)
    slots = token_output._slot(own, moves[(own % np.uint64(len(moves))).astype(np.int64)], len(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))


@settings(max_examples=60, deadline=None)
@given(found=st.lists(st.text(alphabet="abc日", max_size=7), max_size=10, unique=True))
def test_trie_counts(found):
    log_p = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.5, "abc": -4.0, "cab": -3.0, "c": -3.0}

    def best(w):  # every segmentation
        if not w:
            return 0.0, 0
        width = len(w[-1].encode())
        s, n = best(w[:-1])
        options = [(s + width * token_counts.BYTE_LOG_P, n + width)]
        for k in range(max(0, len(w) - 3), len(w)):
            if w[k:] in log_p:
                s, n = best(w[:k])
                options.append((s + log_p[w[k:]], n + 1))
        top = max(s for s, _ in options)
        return top, min(n for s, n in options if s == top)

    assert token_counts.counts(sorted(found), log_p, 3) == [best(w)[1] for w in sorted(found)]


def test_token_counts(spark):
    own = docs(spark, [None, "", " a b  a ", "x" * 5000], [None, 1, 1, 2])
    found = {(r["doc_id"], r["n_words"]): r["n_tokens"] for r in token_counts.token_counts(own).collect()}
    assert found[None, 0] == 0 and found[1, 0] == 0 and found[1, 3] >= 3 and found[2, 1] > 100
    assert token_counts.token_counts(own.limit(0)).count() == 0
    assert queries.op9_token_counts(spark, SF).where("n_tokens >= n_words").count() == 200


# 4


def page(i, article, notice="Read our terms of use first."):
    return f"<html><head><title>t</title></head><body><nav><a>Menu {i}</a></nav><div><p>{notice}</p></div><div><h1>Head {i}</h1>{article}</div><footer>f</footer></body></html>"


def test_names_alone_delete_nothing():
    kept = ['<div class="post search-engines">x</div>', '<section class="related-work">x</section>', '<div class="hidden-gems">x</div>', '<article><p class="social">x</p></article>', '<div class="advertising-history">x</div>']
    gone = ['<div class="ad">x</div>', '<div class="site-header">x</div>', '<ul id="nav_menu"><li>x</ul>', '<div role="navigation">x</div>', "a<!-- x", "<p>a<!-- <b>x</p>"]
    texts = lambda h: [t for t, *_ in html_extract.text_blocks(html_extract.parse(h))]
    assert [texts(h) for h in kept] == [["x"]] * len(kept)
    assert all("x" not in " ".join(texts(h)) for h in gone)


def test_long_lists_of_siblings_match_in_bounded_memory():
    import time
    import tracemalloc

    page = "<div>" + "".join(f"<h3>h{i}</h3><ul><li>a<li>b</ul><p>p{i}</p>" for i in range(3_300)) + "</div>"
    shape = html_extract.Shape("html", [html_extract.parse(page)])
    other = html_extract.Shape("html", [html_extract.parse(page.replace("<h3>h7</h3>", ""))])
    tracemalloc.start()
    began, pairs = time.time(), {}
    assert html_extract.match(shape, other, pairs) >= shape.size - 2
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_wrapper_induction(spark):
    rows = [(i, f"https://one.example.org/{i}", page(i, f"<p>Body {i} &amp; more<p>second\n line {i}<br>x")) for i in range(8)]
    rows += [(20, "https://two.example.org/", page(20, "<p>alone</p>")), (21, None, None), (22, "nonsense", ""), (0, "https://one.example.org/0", rows[0][2])]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {(r["page_id"], r["url"]): r["text"] for r in found}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert text[3, "https://one.example.org/3"] == "Head 3\nBody 3 & more\nsecond line 3 x"  # the notice is template
    assert text[20, "https://two.example.org/"] == "Read our terms of use first.\nHead 20\nalone"
    assert text[21, None] == "" and text[22, "nonsense"] == ""


@pytest.mark.parametrize("behind", ["<div><p>{0}</p></div>", "<div><ul><li>{0}</ul><h2>x</h2></div><div><h3>{0}</h3></div>"])
def test_every_run_has_a_slot(behind):
    root = html_extract.parse(f"<div><h1>Head</h1><p>Body</p></div>{behind.format('Notice')}")
    slots = {t: slot for t, slot, *_ in html_extract.aligned(root, html_extract.load(html_extract.dump(html_extract.Shape("html", [root]))))}
    assert "Notice" in slots and all(slots.values())


def test_wrapper_induction_behind_content(spark):
    html = lambda i: f"<div><h1>Head {i}</h1><p>Body {i}</p></div><div><p>Read our terms.</p></div><div><ul><li>All rights</ul></div>"
    found = html_extract.extract(spark.createDataFrame([(i, f"https://one.example.org/{i}", html(i)) for i in range(8)], "page_id long, url string, html string")).collect()
    assert {r["text"] for r in found} == {f"Head {i}\nBody {i}" for i in range(8)}


def test_no_page_decides_alone(spark):
    body = lambda i: f"<div><h1>Head {i}</h1><p>Body {i}</p></div>"
    deep = lambda i: "<div>" * 70 + f"<p>Deep {i}</p><ul><li>Deep notice</ul>" + "</div>" * 70
    rows = []
    for h in range(12):  # whichever page of a host is the pivot
        rows += [(i, f"https://h{h}.example.org/{i}", body(f"{h} {i}") + "<table><tr><td>Read our terms.</table>" * (i % 4 > 0) + deep(i)) for i in range(12)]
        rows += [(50 + i, f"https://h{h}.example.org/{i}", t) for i, t in enumerate([None, "", "<div></div>", " "])]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    assert all(r["text"] == "" if r["page_id"] >= 50 else r["text"].split("\n")[2:] == [f"Deep {r['page_id']}"] for r in found)


def test_pages(spark):
    found = {r["page_id"]: r["text"] for r in queries.op4_html_extraction(spark, SF).collect()}
    own = spark.read.parquet(f"{SF}/pages.parquet").withColumn("html", F.regexp_replace("html", "(</?)article\\b", "$1div"))
    renamed = {r["page_id"]: r["text"] for r in html_extract.extract(own).collect()}  # no article is marked
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        parts = re.split(r"<p>|</p>|<h1>|</h1>", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        assert found[r["page_id"]] == renamed[r["page_id"]] == "\n".join(t for x in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split())))


def test_boilerplate_by_meaning():
    markup = '<header>h</header><div class="sidebar">s</div><main><article><header><h2>T</h2></header><p>a <a href=x>b</a><p>c<script>var x="</p>"</script><div class="comments"><p>no</p></div><ul><li>1<li>2</ul><aside>no</aside><form>q</form><span class="ad-box share">no</span></article></main>'
    assert [t for t, *_, inside in html_extract.text_blocks(html_extract.parse(markup)) if inside] == ["T", "a b", "c", "1", "2"]


@pytest.mark.parametrize("odd", ["<![foo bar]>", "<![ 1 ]>", "<![>", "<![CDATA[x]]>", "<![if !IE]>", "<![endif]>", "<![IGNORE[>", "<!x>"])
def test_odd_declarations(odd):
    found = " ".join(t for t, *_ in html_extract.text_blocks(html_extract.parse(f"<div><p>before {odd} between</p><p>after</p></div><p>end")))
    assert found == "before between after end"


def test_unclosed_declaration():
    assert [t for t, *_ in html_extract.text_blocks(html_extract.parse("<p>before</p><p>x <![ 1 and on"))] == ["before", "x <![ 1 and on"]


def test_tree_matching():
    shape = lambda t: html_extract.load(t)
    pairs = {}
    a, b = shape(["html", [["nav", []], ["div", [["p", []]]]]]), shape(["html", [["header", []], ["nav", []], ["div", [["h1", []], ["p", []]]]]])
    assert html_extract.match(a, b, pairs) == 4
    assert pairs["/div1/p0"] == "/div2/p1"


# 5


def test_jaccard_odd_inputs(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:55]), " ".join(base[:30]), "A b", "a  B\n", "a c", None, "", " ", " ".join(base), "x"]
    ids = [5, 6, 7, 8, 9, 10, 11, 12, None, 5, None]
    found = [tuple(r) for r in jaccard_join.link(docs(spark, texts, ids)).collect()]
    assert sorted(found, key=str) == sorted([(5, 56, 5), (6, 51, 5), (7, 26, 7), (8, 1, 8), (9, 1, 8), (10, 1, 10), (11, 0, 11), (12, 0, 12), (None, 0, None), (5, 56, 5), (None, 1, None)], key=str)
    assert jaccard_join.link(docs(spark, []).limit(0)).count() == 0


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{i}" for i in range(300)]
    passage = [str(x) for x in rng.choice(vocabulary, 40)]
    texts = []
    for _ in range(40):
        own = [str(x) for x in rng.choice(vocabulary, int(rng.integers(3, 120)))] + passage * int(rng.integers(0, 2))
        texts.append(own)
        for _ in range(int(rng.integers(0, 6))):
            copy = list(own)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(vocabulary))
            texts.append(copy)
    sets = [frozenset(shingles(t)) for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    found = {r["doc_id"]: r for r in jaccard_join.link(docs(spark, [" ".join(t) for t in texts])).collect()}
    assert [found[i]["component_id"] for i in range(len(texts))] == root
    assert [found[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def held(text, items):
    own, out = words(text), set()
    for i, t in items.items():
        w = words(t)
        if not w:
            continue
        n = min(5, len(w))
        c = Counter(shingles(w, n))
        for at in range(max(1, len(own) - len(w) + 1)):
            d = Counter(tuple(own[at : at + len(w)][k : k + n]) for k in range(len(own[at : at + len(w)]) - n + 1))
            if 100 * sum((c & d).values()) >= 80 * sum((c | d).values()) > 0:
                out.add(i)
                break
    return sorted(out)


def test_decontamination(spark, given_docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {r["doc_id"]: r["item_ids"] for r in queries.op7_decontamination(spark, SF).collect()}
    assert found == {i: ",".join(map(str, held(t, items))) for i, t in given_docs.items()}
    assert any(found.values())


def test_decontamination_odd_inputs(spark):
    w = [f"w{i}" for i in range(40)]
    items = {1: " ".join(w), 2: "one TWO three", 3: "", 4: None, 5: " ".join(["r"] * 12)}
    texts = [" ".join(["x"] * 50 + w[:37] + ["y"] + w[38:] + ["z"]), "say one two THREE now", " ".join(w[:20]), "one two", None, "", " ".join(["r"] * 30), " ".join(w[:36])]
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {r["text"]: list(r["item_ids"]) for r in decontamination.mark(docs(spark, texts, [1, 1, 2, None, 3, 4, 5, 6]), benchmark).collect()}
    assert found == {t: held(t, {k: v or "" for k, v in items.items()}) for t in texts}
    assert decontamination.mark(docs(spark, ["a"]), benchmark.limit(0)).where("size(item_ids) = 0").count() == 1
    assert decontamination.mark(docs(spark, []).limit(0), benchmark).count() == 0


def test_decontamination_recall_near_the_threshold(spark):
    """Items with edits that bring them around the threshold, short items included: all that brute force finds are found."""
    rng = np.random.default_rng(11)
    items, texts = {}, []
    for i in range(80):
        n = int(rng.integers(8, 120))
        w = [f"w{i}x{j}" for j in range(n)]
        items[i] = " ".join(w)
        for _ in range(3):
            own = list(w)
            for at in sorted(rng.choice(n, int(rng.integers(0, 2 + n // 40)), replace=False), reverse=True):
                own[at : at + 1] = [["other"], [], [own[at], "more"]][int(rng.integers(3))]
            texts.append(" ".join([f"x{k}" for k in range(int(rng.integers(0, 30)))] + own + ["z"] * int(rng.integers(0, 9))))
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {r["doc_id"]: list(r["item_ids"]) for r in decontamination.mark(docs(spark, texts), benchmark).collect()}
    wanted = {d: held(t, {d // 3: items[d // 3]}) for d, t in enumerate(texts)}
    assert 60 < sum(map(len, wanted.values())) < len(texts) and found == wanted


def test_decontamination_of_repeated_words_and_long_items(spark):
    """Items whose last places one repeated word takes, which a window's fingerprint must not follow, up to 1,004 words; and items that repeat words."""
    items, texts = {}, []
    for n in (104, 304, 1004):
        for share in (0.11, 0.12):
            w = [f"w{n}x{share}x{j}" for j in range(n)]
            k = n - round(share * (n - 4))
            items[len(items)] = " ".join(w)
            texts.append(" ".join(["x"] * 7 + w[:k] + ["r"] * (n - k) + ["z"] * 5))
            items[len(items)] = " ".join(w[:k] + [f"q{n}"] * (n - k))  # the other way round
            texts.append(" ".join(["y"] * 3 + w))
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {r["doc_id"]: set(r["item_ids"]) for r in decontamination.mark(docs(spark, texts), benchmark).collect()}
    for d, t in enumerate(texts):
        near = {i: items[i] for i in items if items[i].split()[0] in t.split()}
        assert found[d] == set(held(t, near))
    assert 12 <= sum(map(len, found.values())) < 24


def test_blocks_guarantee_the_radius(spark):
    """Fingerprints at the radius, with their bits wherever they are, share a filed value in some block."""
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(300):
        x = int(rng.integers(-(2**63), 2**63 - 1))
        flips = sum(1 << int(b) for b in rng.choice(64, decontamination.RADIUS, replace=False))
        rows.append((x, int(np.array((x ^ flips) & (2**64 - 1), np.uint64).view(np.int64))))
    pairs = spark.createDataFrame(rows, "x long, y long")
    met = pairs.select(F.arrays_overlap(decontamination.blocks(F.col("x"), decontamination.RADIUS), decontamination.blocks(F.col("y"))).alias("met"))
    assert met.where("met").count() == len(rows)


def test_decontamination_of_reordered_items(spark):
    w = [f"w{i}" for i in range(50)]
    x, items = [f"x{i}" for i in range(80)], {1: " ".join(w), 2: " ".join(w[:30])}
    swapped = [w[25:] + w[:25], w[40:] + w[:40], w[20:30] + w[:20]]
    texts = [" ".join(own) for s in swapped for own in (s, x + s, s + x, x + s + x)] + [" ".join(x + w[30:] + w[15:30] + w[:15] + x)]
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {r["text"]: list(r["item_ids"]) for r in decontamination.mark(docs(spark, texts), benchmark).collect()}
    assert found == {t: held(t, items) for t in texts}
    assert all(1 in found[t] for t in texts[:8])


def test_blocks_need_little_code(spark):
    prints = [0, -1, 1 << 63 - 8, -(1 << 63), 0x0123456789ABCDEF]
    frame = spark.createDataFrame([(x,) for x in prints], "x long").select("x", F.explode(decontamination.blocks(F.col("x"), decontamination.RADIUS)).alias("b")).select("x", "b.*")
    near = lambda v: {v ^ m for m in range(256) if m.bit_count() <= 2}
    assert {tuple(r) for r in frame.collect()} == {(x, i, v) for x in prints for i in range(8) for v in near(x >> 8 * i & 255)}
    stages = frame._jdf.queryExecution().debug().codegenToSeq()
    assert sum(len(stages.apply(i)._2()) for i in range(stages.size())) < 50_000


def test_decontamination_files_fingerprints_alone(spark, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = {i: item for i in range(40)} | {50: "other words stand in this item that nobody has copied"}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = [f"before {item} after", "nothing of it", item]
    written = {}
    monkeypatch.setattr(decontamination, "materialize", lambda df, label, f=decontamination.materialize: written.setdefault(label, f(df, label)))
    found = {r["text"]: list(r["item_ids"]) for r in decontamination.mark(docs(spark, texts), benchmark).collect()}
    assert found == {t: held(t, items) for t in texts} and list(map(len, found.values())).count(40) == 2
    filed = written["item-blocks"]  # goes to every task, and through the driver, with some hundred rows for each fingerprint
    assert {kind for _, kind in filed.dtypes} == {"bigint"} and filed.count() == 2 * 8 * 37
    written.clear()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)  # items that are too many to be broadcast
    assert {r["text"]: list(r["item_ids"]) for r in decontamination.mark(docs(spark, texts), benchmark).collect()} == found


# 8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


TEXTS = ["token=token:abcdef", 'API_KEY": "abcdef123"', "x😀 passwd = 12345 Secret:abcdefg", "AKIA" + "Z" * 16 + " AKIA" + "Z" * 15, "f" * 24 + "g" + "a" * 23, "password=" + "0" * 30, "apikey=AKIA" + "1" * 20, None, "", "key", "tokentoken=abcdefg,token=1234567" * 3, "-----BEGIN RSA PRIVATE KEY-----", "gho_" + "Q" * 36]


def test_secrets(spark):
    found = secrets.scan(docs(spark, TEXTS + TEXTS[:2], [*range(len(TEXTS)), 0, None])).select("text", "found", "kinds").collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        base = [(x["start"], x["rank"], x["end"]) for x in r["found"] if x["rank"] < 3]
        assert base == spans(r["text"]), r["text"]
    assert sum(len(r["found"]) - len(spans(r["text"])) for r in found) == 2
    assert secrets.scan(docs(spark, []).limit(0)).count() == 0


def test_secret_query(spark, given_docs):
    kinds = [r.kind for r in secrets.BASE_RULES]
    for r in queries.op8_secret_scans(spark, SF).collect():
        own = spans(given_docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in own).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in own) for j in range(3)]


def test_many_secrets(spark):
    """Running totals over more matches than one run of them holds."""
    texts = ["é token=abcdef%d " % i * 700 for i in range(3)] + ["a" * 24 + " password=" + "b" * 30 + " " + "c" * 25 + "password=" + "d" * 9]
    found = secrets.scan(docs(spark, texts)).select("text", "found", secrets.redacted(F.col("text"), F.col("found")).alias("clean")).collect()
    for r in found:
        own = spans(r["text"])
        assert [(x["start"], x["rank"], x["end"]) for x in r["found"]] == own
        out, at = [], 0
        for a, _, b in own:
            if a >= at:
                out.append(r["text"][at:a])
            at = max(at, b)
        assert r["clean"] == "[SECRET]".join([*out, r["text"][at:]])


def test_redaction(spark):
    found = secrets.scan(docs(spark, ["a password=" + "0" * 30 + " b token:abcdef", "clean"])).select(secrets.redacted(F.col("text"), F.col("found")).alias("t")).collect()
    assert [r["t"] for r in found] == ["a [SECRET] b [SECRET]", "clean"]


def test_trigram_queries():
    query = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert query["access"] == [frozenset({"aki", "kia"})] and query["hex"] == []
    assert frozenset({"tok", "oke", "ken"}) in query["assign"] and len(query["assign"]) == 6
    assert secrets.trigram_query("a+b") == [] and secrets.trigram_query("abc|x") == [] and secrets.trigram_query("(?:abc)?d") == []
    assert secrets.trigram_query("ab[cd]e") == sorted([frozenset({"abc", "bce"}), frozenset({"abd", "bde"})], key=sorted)


# 10


def near_vectors(vectors):
    """n_links and component of each vector by all pairs of equal length. vectors: id, list or None."""
    good = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links, root = Counter(), {i: i for i, _ in vectors}
    for i, j in combinations(sorted(good), 2):
        x, y = good[i], good[j]
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
            links[i] += 1
            links[j] += 1
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = {k: new if r == old else r for k, r in root.items()}
    return {i: (links[i], root[i], root[i] == i) for i, _ in vectors}


def of_vectors(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 32)) + 0.5  # not centred
    rows = [v.tolist() for b in base for v in [b, *(b + rng.normal(size=32) * s for s in (0.1, 0.2, 0.4))]] + [base[0].tolist(), (base[0] * 2).tolist(), [0.0] * 32]
    rows = [*enumerate(rows), (900, None), (901, [1.0, None]), (902, [float("nan")] * 32), (903, [1.0, 2.0]), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.1]), (907, [-1.0, 2.0]), (908, [3.0]), (909, [1.0]), (910, [-1.0])]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, wanted = of_vectors(embedding_dedup.near(own)), near_vectors(rows)
    assert found == wanted and found[903][0] == 2 and found[909] == (1, 908, False)
    assert embedding_dedup.near(own.limit(0)).count() == 0


def test_embedding_query(spark):
    """The query's rows are those of brute force (which finds no link here; bench tables with links are in the README)."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert of_vectors(queries.op10_embedding_dedup(spark, SF)) == near_vectors(rows)


def test_index_blocks():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(rng.normal(size=(500, 16)) + 0.4)
    index = embedding_dedup.Index(x, 500)
    bits = index.bits(x)
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.15  # balanced, though the vectors' mean is far from zero
    tight = embedding_dedup.unit(np.ones(16) + rng.normal(size=(300, 16)) * 0.05)
    assert embedding_dedup.Index.best(tight, 300).blocks < embedding_dedup.MOST
    assert embedding_dedup.Index.best(embedding_dedup.unit(rng.normal(size=(4, 2))), 4).blocks < embedding_dedup.MOST
    have, ask = index.files(x)
    near = (bits[:, None] != bits[None]).sum(axis=3).min(axis=2) <= embedding_dedup.PROBED
    assert all(bool(set(ask[i]) & set(have[j])) == near[i, j] for i in range(40) for j in range(500))


def test_rounded_vectors_bound_the_cosine():
    rng = np.random.default_rng(3)
    for d in (1, 2, 64, 1000):
        x = embedding_dedup.unit(rng.normal(size=(400, d)) * rng.choice([1e-6, 1, 30], size=(400, d)) if d > 2 else rng.normal(size=(400, d)))
        y = embedding_dedup.unit(x + rng.normal(size=(400, d)) * rng.choice([0, 1e-9, 0.01, 0.3], size=(400, 1)) / d**0.5)
        cosines, most = (x * y).sum(axis=1), embedding_dedup.bound(embedding_dedup.rounded(x), embedding_dedup.rounded(y))
        assert (most >= cosines).all()
    x, y = (embedding_dedup.unit(rng.normal(size=(400, 64))) for _ in range(2))
    assert (embedding_dedup.bound(embedding_dedup.rounded(x), embedding_dedup.rounded(y)) - (x * y).sum(axis=1)).max() < 0.05


def test_strangers_are_not_shuffled_as_doubles(spark):
    """Candidates that are far from each other, as most are, leave before whole vectors are joined to them."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    rng, before = np.random.default_rng(8), shuffled()
    rows = list(enumerate(rng.normal(size=(2000, 64)).tolist()))
    with common.settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = of_vectors(embedding_dedup.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert found == {i: (0, i, True) for i, _ in rows}
    most = max(size for stage, size in shuffled().items() if stage not in before)
    assert most < 2 * 2000 * 64 * 8
