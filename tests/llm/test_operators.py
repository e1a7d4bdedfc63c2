"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from stridemill.llm import bpe, chat, html, jaccard, language, mixing, pairs, pii, quality, sharding, tagger, vectors

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "x", "é" * 3, "one two three four", "!!! ###\n###", "a" * 5000, "w " * 3000]


def segments(spark, texts, **columns):
    names = ["segment_id", "text", *columns]
    kinds = "segment_id long, text string, " + ", ".join(f"{c} string" for c in columns)
    rows = [tuple(x) for x in zip(range(len(texts)), texts, *columns.values(), strict=True)]
    return spark.createDataFrame(rows, kinds.rstrip(", ")).select(names)


def prose(rnd, words, size=60):
    return " ".join(rnd.choice(words) for _ in range(size))


def components(ids, links):
    low = {i: i for i in ids}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        low[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_shards_follow_the_published_loop_and_grow_into_the_new_one(spark):
    def plain(key, shards):
        b, j = -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    for shards in (1, 7, 40):
        assert sharding.jump(keys, shards).tolist() == [plain(int(k), shards) for k in keys]
    rows = segments(spark, ODD * 30, shard=["clash"] * len(ODD) * 30).unionByName(segments(spark, ODD[:3], shard=[None] * 3))
    out = sharding.shard_segments(rows, 5, slot_rows=10).collect()
    assert len(out) == len(ODD) * 30 + 3
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_segments(rows.limit(0), 5).count() == 0
    hot = segments(spark, ["same"] * 90 + ODD).withColumn("segment_id", F.lit(None).cast("long"))
    slots = [r.slot for r in sharding.shard_segments(hot, 3, slot_rows=5).collect()]
    assert sorted(slots) == list(range(90 + len(ODD)))


def test_quality_counts_match_loops_over_words_and_lines(spark):
    rnd = random.Random(2)
    texts = [*ODD, *["".join(rnd.choice(["a ", "b ", "cé ", "\n", "x#\t", "a b c d e f\n"]) for _ in range(rnd.randrange(200))) for _ in range(60)]]
    got = {r.segment_id: r for r in quality.rate_segments(segments(spark, texts, kept=["clash"] * len(texts))).collect()}

    def inside(words, n, later):
        seen, count = {}, collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = set()
        for i in range(len(words) - n + 1):
            g = tuple(words[i : i + n])
            if (g in seen) if later else count[g] > 1:
                hit |= set(range(i, i + n))
            seen[g] = i
        return hit

    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        lines, seen, dup = (text or "").split("\n"), set(), []
        for line in lines:
            if WORD.search(line):
                dup += [line] if line in seen else []
                seen.add(line)
        repeat = len(inside(words, 3, False))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(dup), repeat)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        for n in (5, 7, 10):
            assert r[f"window_{n}_chars"] == sum(len(words[k]) for k in inside(words, n, True))
        assert r.base_failed == (len(words) < 50 or 100 * repeat > 50 * len(words)) and not (r.base_failed and r.kept)
    assert got[len(ODD) - 1].kept is False
    assert quality.rate_segments(segments(spark, ["x"]).limit(0)).count() == 0


def test_language_is_learned_and_unknown_without_letters(spark):
    rnd = random.Random(3)
    vocabularies = {"aa": ["lumo", "tira", "pesk", "ona"], "bb": ["schra", "über", "ßten", "zwak"]}
    labels = ["aa", "bb"] * 40
    texts = [prose(rnd, vocabularies[k]) for k in labels]
    rows = segments(spark, [*texts, *ODD], lang=[*labels, *[None] * len(ODD)])
    held = language.held_out(rows["segment_id"])
    model = language.train_language(rows.filter(~held))
    got = {r.segment_id: r for r in language.predict_language(rows.drop("lang"), model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].lang_score <= 1 for i, k in enumerate(labels))
    for i, text in enumerate(ODD, len(texts)):
        assert (got[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", text or ""))
    nothing = language.train_language(rows.filter("lang is null"))
    assert {r.lang_pred for r in language.predict_language(rows, nothing).collect()} == {"und"}


def test_mix_meets_targets_and_is_repeatable(spark):
    rnd = random.Random(4)
    envs = [rnd.choice(["a", "b", "c", None]) for _ in range(600)]
    texts = ["w " * rnd.choice([0, 1, 5, 30, 200]) for _ in envs]
    rows = segments(spark, [*texts, *ODD], env=[*envs, *[None] * len(ODD)])
    out = mixing.mix_segments(rows, block_rows=200).collect()
    assert len(out) == 600 + len(ODD)
    assert sorted(out) == sorted(mixing.mix_segments(rows.repartition(3), block_rows=200).collect())
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        size[r.env] += r.size
        taken[r.env] += r.taken
        target[r.env] = r.target
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(1.5 * total)
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    level = max(target[e] / weight[e] for e in target)
    for e in target:
        assert target[e] == pytest.approx(min(2 * size[e], level * weight[e]))
        assert abs(taken[e] - target[e]) <= 210
    assert mixing.mix_segments(rows.limit(0)).count() == 0


def test_long_texts_are_stitched_as_the_encoder_would(spark):
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    letters = " \n\t\r  abé中1290'st!?\x1c\x85　\U0001f600_|é ñ"
    texts = [*ODD, *["".join(rnd.choice(letters) for _ in range(rnd.choice([1, 5, 50, 700]))) for _ in range(150)], "x" * 300 + " " * 300 + "y" * 300]
    rows = segments(spark, texts, part=["clash"] * len(texts))
    encoded = bpe.encode_segments(rows, RANKS, PATTERN, chunk=40, overlap=12)
    got = {r.segment_id: r for r in bpe.digests(bpe.decode_segments(encoded, RANKS, PATTERN)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = np.array(plain.encode_ordinary(text or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest()), text
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_segments(rows.limit(0), RANKS, PATTERN).count() == 0


def test_messages_read_back_from_their_tokens(spark):
    awkward = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>[", "[\\INST]<s>", "", None, "plain é"]
    for text in awkward[:5]:
        shown = chat.escape(text)
        assert chat.unescape(shown) == text and not any(c in shown for c in chat.CONTROLS)
    turns = [(k, t, role, text) for k in (1, 2, None) for t, (role, text) in enumerate([*[("user", x) for x in awkward], *[("assistant", x) for x in awkward], (None, "z"), ("assistant", "z"), ("assistant", "z")])]
    messages = spark.createDataFrame(turns, "trajectory_id long, t long, role string, text string")
    formatted = chat.format_messages(messages, RANKS, PATTERN)
    starts = [(r.token_start, len(r.ids) // 4) for r in formatted.filter("trajectory_id = 1").orderBy("seq").collect()]
    assert all(b[0] == a[0] + a[1] for a, b in zip(starts[:-1], starts[1:], strict=True)) and starts[0][0] == 0
    for r in chat.conversation_digests(chat.read_messages(formatted, RANKS, PATTERN)).collect():
        own = [(role or "", text or "") for k, _, role, text in turns if k == r.trajectory_id]
        said = "".join(text for role, text in own if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_messages(messages.limit(0), RANKS, PATTERN).count() == 0


def plain_base(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [(*m.span(), "ip")] if all(int(p) <= 255 for p in m[0].split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        out += [(*m.span(), "card")] if 13 <= len(digits) <= 19 and pii.luhn(digits) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [(*m.span(), "phone")] if 9 <= len(re.findall("[0-9]", m[0])) <= 15 else []
    return out


def test_base_spans_are_the_leftmost_matches():
    rnd = random.Random(6)
    for _ in range(4000):
        text = "".join(rnd.choice("a@.+- 0123(1b4)é") for _ in range(rnd.randrange(60)))
        assert pii.base_spans(text) == plain_base(text)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000) == []


def test_tagger_gradients_agree_with_differences():
    model = tagger.Tagger.new()
    for name in model.FIELDS:
        setattr(model, name, getattr(model, name).astype(np.float64))
    x = np.random.default_rng(0).integers(0, tagger.SYMBOLS, (3, 7))
    gold = np.array([[0, 1, 2, 0, 3, 4, 0]] * 3)
    _, grads = model.gradients(x, gold)
    for name in model.FIELDS:
        array = getattr(model, name)
        at = np.unravel_index(np.argmax(np.abs(grads[name])), array.shape)
        kept, losses = array[at], []
        for step in (1e-5, -1e-5):
            array[at] = kept + step
            losses.append(model.gradients(x, gold)[0])
        array[at] = kept
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3)


def test_tagger_learns_spans_and_adds_without_touching_base_ones(spark):
    rnd = random.Random(7)
    filler = ["the", "of", "anre", "tion", "er", "12", "7", "and"]

    def text():
        made = [f"{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}.{rnd.randrange(256)}", f"ab.{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.com"]
        return " ".join([prose(rnd, filler, 12), rnd.choice(made), prose(rnd, filler, 12)])

    texts = [*[text() for _ in range(150)], *ODD]
    rows = segments(spark, texts, clean_text=["clash"] * len(texts))
    model = pii.train_tagger(rows, epochs=25)
    found = pii._decoded(model, texts[:100])
    base = [{(a, b, k) for a, b, k in pii.base_spans(t)} for t in texts[:100]]
    hits = sum(len(b & {(s, e, k) for _, s, e, k in f}) for b, f in zip(base, found, strict=True))
    assert hits >= 0.8 * sum(map(len, base))
    for r in pii.find_personal_data(rows, model).collect():
        source = texts[r.segment_id]
        spans = [(s.start, s.end, s.kind) for s in r.base_spans]
        assert spans == sorted(plain_base(source or ""), key=lambda x: (tagger.KINDS.index(x[2]), x[0]))
        assert r.clean_text == source if not spans and not r.added_spans else not plain_base(r.clean_text)
    assert pii.train_tagger(rows.filter("text is null")) is None
    assert pii.find_personal_data(rows.limit(0), None).count() == 0


def test_near_duplicates_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 8)  # several blocks in every hot bucket and component
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(12):
        own = [rnd.choice(words) for _ in range(80)]
        for _ in range(30 if k == 0 else 5):
            copy = list(own)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(80)] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += [*ODD, *ODD, texts[0], texts[0], "one  two\nthree four"]
    got = {r.segment_id: r for r in jaccard.join_segments(segments(spark, texts, component=["clash"] * len(texts))).collect()}
    sets = []
    for text in texts:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    count, low = collections.Counter(x for pair in links for x in pair), components(range(len(texts)), links)
    assert len(got) == len(texts) and len(links) > 100
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], low[i], low[i] == i)
    assert jaccard.join_segments(segments(spark, ["x"]).limit(0)).count() == 0


def test_rows_of_repeated_and_null_ids_link_by_their_own_texts(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        own = [rnd.choice(words) for _ in range(140)]
        for n in range(4):
            copy = list(own)
            copy[rnd.randrange(140)] = rnd.choice(words)
            rows.append(((None, 7, 7, 100 + k)[n], " ".join(copy)))
    rows += [(7, None), (None, None), (7, ""), (None, " "), (7, None), (None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1])]
    sets = []
    for _, text in rows:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    count, low = collections.Counter(x for pair in links for x in pair), components(range(len(rows)), links)
    want = collections.Counter()
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in low if low[j] == low[i] and rows[j][0] is not None] if sets[i] else [own]
        least = min(ids, default=None)
        want[own, count[i], least, own == least] += 1
    table = spark.createDataFrame(rows, "segment_id long, text string")
    got = collections.Counter(tuple(r) for r in jaccard.join_segments(table).select("segment_id", "n_links", "component_id", "kept").collect())
    assert len(links) > 50 and got == want


def test_pruning_keeps_pairs_that_may_reach_the_threshold():
    limits = jaccard.least_matches()
    assert [n for n, _ in limits] == [11, 22, 33, 44, 55, 66]
    assert all(m < 0.8 * n for n, m in limits) and limits[-1][1] > 25


def test_equal_direction_skills_are_linked(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_NODES", 16)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    rows = [centres[i % 20] + rng.normal(size=16) * 0.06 for i in range(200)] + [centres[0] + rng.normal(size=16) * 0.03 for _ in range(60)]
    embeddings = [v.astype(np.float32).tolist() for v in rows]
    embeddings += [embeddings[0], embeddings[0], (np.array(embeddings[1]) * 1e-20).tolist(), [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [1.0, 2.0]]
    labels = [1] * (len(embeddings) - 2) + [None, 1]
    table = spark.createDataFrame([(i, e, k) for i, (e, k) in enumerate(zip(embeddings, labels, strict=True))], "skill_id long, embedding array<float>, granularity int")
    got = {r.skill_id: r for r in vectors.link_skills(table).collect()}
    good = [i for i, e in enumerate(embeddings) if labels[i] is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    unit = {i: np.array(np.float32(embeddings[i]), float) / np.linalg.norm(np.float64(np.float32(embeddings[i]))) for i in good}
    links = [(i, j) for i in good for j in good if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    count, low = collections.Counter(x for pair in links for x in pair), components(range(len(embeddings)), links)
    assert len(links) > 500 and len(got) == len(embeddings)
    for i in range(len(embeddings)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], low[i], low[i] == i), i


def test_forest_joins_chains():
    assert pairs.forest(6, np.array([0, 2, 1]), np.array([2, 3, 3])).tolist() == [0, 0, 0, 0, 4, 5]


def test_pages_are_read_by_their_hosts_paths(spark):
    page = "<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>menu</a></nav><div class='{box}'><h1>Head</h1><p>First &amp; <b>bold\n text<p>Second<br>line</p><div class=share>share</div><section class='comments'><p>reader comment here</p></section></div><div id=sidebar>{side}</div><form>f</form><script>var a='</p>';</script><!-- x --><footer>foot"
    rows = [(i, "http://a.example/x", page.format(box=f"post-{i}", side="s")) for i in range(5)]
    # one page whose unmarked box is longer than its article; the host's other pages outvote it
    rows.append((5, "http://a.example/y", page.format(box="post-9", side="s").replace("<form>", "<div class=extra><p>" + "long box text " * 40 + "</p></div><form>")))
    rows += [(6, None, None), (7, "http://b.example", ""), (8, "nonsense", "only text"), (9, "http://a.example/z", "<p>other <")]
    steps = spark.createDataFrame(rows, "page_id long, url string, observation string").selectExpr("*", "'clash' AS text")
    got = {r.page_id: r.text for r in html.extract_text(steps).collect()}
    assert {got[i] for i in range(6)} == {"Head\nFirst & bold text\nSecond line"}
    assert (got[6], got[7], got[8], got[9]) == ("", "", "only text", "other <")
    assert html.extract_text(steps.limit(0)).count() == 0


@pytest.mark.parametrize("opening, closing", [
    ('<div class="content no-sidebar">', "</div>"), ('<div id="main-with-sidebar">', "</div>"), ('<div class="post comment-open">', "</div>"),
    ('<form id="aspnetForm"><div class="page with-sidebar">', "</div></form>"), ('<aside><main>', "</main></aside>"),
    ('<main><div class="post comment-open">', "</div></main>"),
])
def test_wrappers_named_like_clutter_keep_their_article(opening, closing):
    story = "<h1>Head</h1><p>First long paragraph of the story.</p><p>Second paragraph of it.</p><div class=ad>buy</div>"
    clutter = "<div class=sidebar>side text</div><div id=comments>" + "<div class=comment><p>a reader says something here</p></div>" * 5 + "</div>"
    want = "Head\nFirst long paragraph of the story.\nSecond paragraph of it."
    for inner, outer in ((clutter, ""), ("", clutter)):
        page = html.parse(f"<html><body><header>Site</header>{opening}{story}{inner}{closing}{outer}<footer>foot</footer></body></html>")
        assert html.text_at(page, [html.best_path(page)[0]]) == want
    # comments without marks of their own, longer than the article beside them
    page = html.parse(f"<body><div class=story>{story}</div><div id=comments><p>{'reader words ' * 12}</p></div></body>")
    assert html.text_at(page, [html.best_path(page)[0]]) == want


def test_tagger_adds_disguised_data_and_leaves_decoys_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("doc_id", "segment_id")
    model = pii.train_tagger(docs)
    words = [w for r in docs.select("text").limit(40).collect() for w in (r.text or "").split() if not re.search(r"[^A-Za-z.,]", w)]
    rng = np.random.default_rng(11)

    def around(value):
        at = int(rng.integers(len(words) - 40))
        lead = " ".join(words[at : at + 15])
        return len(lead) + 1, f"{lead} {value} {' '.join(words[at + 15 : at + 40])}"

    found = 0
    for kind in pii.KINDS * 40:
        value = pii.disguised(kind, rng)
        at, text = around(value)
        base, added = pii.all_spans(model, [text])[0]
        found += (at, at + len(value), kind) in base + added
    assert found >= 0.9 * 4 * 40
    texts = [around(pii.decoy(rng))[1] for _ in range(200)]
    assert sum(bool(added) for _, added in pii.all_spans(model, texts)) <= 2


def test_tagger_sees_whole_texts_and_repeated_rows_once(spark):
    late = "word " * 4000 + "mail ab@cd.example.com end"
    rows = segments(spark, [late] * 50 + ["plain 12"])
    rows = rows.withColumn("segment_id", rows.segment_id % 2)
    drawn = pii._drawn_windows(rows, "segment_id", 400, 6)
    assert sum("ab@cd.example.com" in w and spans == [(w.index("ab@"), w.index("ab@") + 17, "email")] for w, spans in drawn) >= 2
    assert len(drawn) <= 3 * 6


def test_links_and_paragraphs_count_at_any_depth():
    story = "".join(f"<p>Sentence {i} of the story goes on for a while.</p>" for i in range(6))
    teaser = "<a href=x><b><i><u><em><span>Read this other long headline of another page now</span></em></u></i></b></a>"
    page = html.parse(f"<body><div class=story>{story}</div><div class=more>{teaser * 8}</div></body>")
    assert html.best_path(page)[0] == "body div.story"
    assert "headline" not in html.text_at(page, [html.best_path(page)[0]])


def test_pages_of_a_hundred_thousand_open_or_stray_tags_stay_small():
    import resource
    import time

    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    deep = html.parse("<body><p>intro</p>" + "<font>" * 100_000 + "end of it" + "<div>x</div></em>" * 2_000)
    assert html.text_at(deep, []).startswith("intro\nend of it")
    stray = html.parse("<body>" + "<div>" * 50_000 + "</b></i></li>" * 50_000 + "text" + "</div>" * 50_000)
    assert html.text_at(stray, []) == "text"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000 and time.perf_counter() - start < 60


def test_votes_equal_a_plain_count_per_host(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(60):
        host = f"h{i % 4}.example.org"
        box = rnd.choice(["story", "post x1", "post x2"]) if i % 5 else "odd w-1/2"
        text = "".join(f"<p>{prose(rnd, ['word', 'other', 'thing'], 20)}</p>" for _ in range(3))
        rows.append((i, f"https://{host}/p{i}", f"<body><div class='{box}'>{text}</div><div class=links><a>{prose(rnd, ['l'], 9)}</a></div></body>"))
    votes = collections.defaultdict(collections.Counter)
    for _, url, page in rows:
        path, score = html.best_path(html.parse(page))
        votes[url.split("/")[2]][path] += score
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id int, url string, observation string")).collect()}
    for i, url, page in rows:
        ranked = sorted(votes[url.split("/")[2]].items(), key=lambda v: (-v[1], v[0]))[: html.PATHS_PER_HOST]
        assert got[i] == html.text_at(html.parse(page), [p for p, _ in ranked])
