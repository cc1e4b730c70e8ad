import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from lodeline.llm import chat, components, hamming, lines, media, mixing, packing, quality, simhash, tokens, toxicity, urls
from lodeline.llm.common import table

WORD = re.compile("[^\x20\x09-\x0d]+")


def pdf(df):
    return df.toPandas()


# 1 token counts


def test_token_counts_equal_the_library(spark, sf_dir, docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.public_path(tokens.MODEL))
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect()]
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=str) == sorted(want, key=str) and key
    big = pdf(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = pdf(tokens.query(spark, sf_dir)).set_index("doc_id").n_tokens
    assert [found[i] for i in big.doc_id] == [len(x) for x in model.encode(big.text.tolist())]


def test_token_counts_random_strings():
    import sentencepiece

    path = tokens.public_path(tokens.MODEL)
    model, mine, rnd = sentencepiece.SentencePieceProcessor(model_file=path), tokens.merger(path), random.Random(3)
    for _ in range(2000):
        t = "".join(rnd.choice("ab th▁ \n<>s/é日\t.in") for _ in range(rnd.randrange(50)))
        assert mine.count(t) == len(model.encode(t)), repr(t)


# 2 SimHash


def slow_fingerprint(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0


def slow_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check_simhash(got, rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = slow_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    want = [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, comp)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_simhash_equals_brute_force(spark, sf_dir, docs, rows):
    from pyspark.sql import functions as F

    found = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    check_simhash([tuple(r) for r in found.collect()], [(i, t) for i, t, _ in rows])
    big = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    check_simhash([tuple(r) for r in simhash.query(spark, sf_dir).collect()], [tuple(r) for r in big])


@pytest.mark.parametrize("low", [16, 24])
def test_simhash_links_random_balls(spark, monkeypatch, low):
    monkeypatch.setattr(hamming, "LOW", low)
    monkeypatch.setattr(hamming, "VARIANTS", 20_000)
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(8))) for c in centres for _ in range(60)} | {0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for radius in (2, 4):
        links = hamming.ball_links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius, len(fps))
        found = {r.node: r.component for r in components.components(links).collect()}
        comp = slow_components(fps, radius)
        groups = {}
        for s, c in zip(signed, comp):
            groups.setdefault(c, []).append(s)
        assert found == {s: min(g) for g in groups.values() if len(g) > 1 for s in g}
    with pytest.raises(ValueError):
        hamming.ball_links(spark.createDataFrame([(1,)], "fp long"), 3, 1)


def test_balls_hold_every_variant():
    assert hamming.ball_size(64, 2) == 2081 and hamming.ball_size(16, 2) == 137 and hamming.ball(5, 0).tolist() == [0]
    fp = np.array([0x123456789ABCDEF0], np.uint64)
    lows, fps = hamming.deal(fp, 16, 4)
    made = set()
    for low, f in zip(lows.tolist(), fps.tolist()):
        left = 2 - ((f ^ low) & 0xFFFF).bit_count()
        made |= {(f >> 16 << 16 | low) ^ int(m) << 16 for m in hamming.ball(48, left)}
    assert made == {int(fp[0]) ^ int(m) for m in hamming.ball(64, 2)}


@pytest.mark.parametrize("local", [components.LOCAL, 20])
def test_components_of_chains_and_hubs(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}


def test_keep_one_and_empty(docs, no_docs):
    kept = pdf(simhash.keep_one(docs))
    assert list(kept.columns) == docs.columns
    ids = kept.doc_id.dropna().astype(int).tolist()
    assert ids == sorted(set(ids)) or len(ids) == len(set(ids))
    assert {1, 8, 9, 4} <= set(ids) and 3 not in ids and 5 not in ids and 6 not in ids
    assert simhash.near_duplicates(no_docs).count() == 0


# 3 toxicity


def test_toxicity_learns_words_and_holds_out(spark, sf_dir):
    found = pdf(toxicity.query(spark, sf_dir.replace("0.001", "0.01"))).merge(pd.read_parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet"), on="doc_id")
    held = found[found.held_out]
    assert (held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()
    assert (held.predicted == held.toxic).mean() > 0.85
    assert ((found.score >= 0.5) == (found.predicted == 1)).all() and found.score.between(0, 1).all()


def test_toxicity_defined_cases(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (8, 0, 1), (8, 1, 0), (77, 0, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert model and toxicity.scores(docs, model).count() == len(rows)
    assert toxicity.fit(docs, labels.limit(0)) == {}
    assert {r.score for r in toxicity.scores(docs, {}).collect()} == {0.0}
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert toxicity.drop_toxic(no_docs, labels).count() == 0


def slow_features(text):
    """Buckets of words, stems by count, bigrams and skip-grams, with plain integers."""
    full, top = (1 << 64) - 1, 64 - toxicity.BITS
    words = [w.strip(b".,;:!?\"'()[]{}*#$%&<>|-") or w for w in text.encode().lower().split()]
    h = [xxhash.xxh64_intdigest(w) for w in words]
    stems = Counter(xxhash.xxh64_intdigest(w.decode(errors="replace")[:5].encode(), 1) for w in words)
    out = {x >> top for x in h} | {(x * (2 * n + 1) & full) >> top for x, c in stems.items() for n in (1, 2, 3) if c >= n}
    for gap, mix in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        for a, b in zip(h, h[gap:]):
            x = (a * 0x9E3779B97F4A7C15 ^ b * mix) & full
            out.add(((x ^ x >> 29) * 0x9E3779B97F4A7C15 & full) >> top)
    return out


def test_toxicity_scores_equal_a_plain_sum(spark, docs, rows):
    for _, t, _ in rows:
        assert set(toxicity.features((t or "").encode()).tolist()) == slow_features(t or "")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 1), (7, 0, 1), (8, 1, 0), (9, 0, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model["index"].tolist(), model["weight"].tolist()))
    want = {}
    for i, t, _ in rows:
        total = weights.get(1 << toxicity.BITS, 0.0) + sum(weights.get(f, 0.0) for f in slow_features(t or ""))
        want.setdefault(i, set()).add(round(1 / (1 + np.exp(-total)), 4))
    assert all(round(r.score, 4) in want[r.doc_id] for r in toxicity.scores(docs, model).collect())


def test_training_is_bounded(spark, make_docs, monkeypatch):
    docs = make_docs([(i % 3, f"text {i} " + "word " * i, "s") for i in range(600)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] * 2, "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, labels, 2).collect()
    assert len(got) <= 2 and len({r.doc_id for r in got}) == len(got)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([bytes(400)] * 10, pa.binary()), pa.array([1] * 10)], names=["found", "toxic"])
    assert len(toxicity.bounded(iter([batch]), 1000)) == 2 and len(toxicity.bounded(iter([batch]), 10)) == 1
    assert toxicity.bounded(iter([]), 10) == []


def test_ftrl_matches_a_plain_loop():
    rnd = random.Random(1)
    data = [(np.array(sorted(rnd.sample(range(16), 5)), np.uint32), rnd.randrange(2)) for _ in range(60)]
    z, n, size = Counter(), Counter(), 16
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        one = 0 if i == size else l1
        return 0.0 if abs(z[i]) <= one else -(z[i] - np.sign(z[i]) * one) / ((b + n[i] ** 0.5) / a + l2)

    for _ in range(2):
        for x, y in data:
            index = [*map(int, x), size]
            w = {i: weight(i) for i in index}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in index:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * w[i]
                n[i] += g * g
    index, weights = toxicity.train(data, bits=4, epochs=2)
    assert np.allclose(weights, [weight(i) for i in index]) and set(index) == {i for i in range(size + 1) if weight(i)}


# 4 quality rules


def slow_measure(text):
    ws = WORD.findall(text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    upper, letters = (len(re.findall(p, text)) for p in ("[A-Z]", "[A-Za-z]"))
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), upper, letters, len(full))


def test_quality_equals_brute_force(spark, sf_dir, docs, rows, no_docs):
    rnd = random.Random(2)
    texts = [t or "" for _, t, _ in rows] + ["".join(rnd.choice("ab \n#A") for _ in range(rnd.randrange(80))) for _ in range(300)]
    for t in texts:
        assert quality.measure(t.encode()) == slow_measure(t), repr(t[:80])
    found = quality.apply_policy(quality.ledger(docs))
    assert sorted(map(str, ((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in found.collect()))) == sorted(map(str, ((i, *slow_measure(t or "")) for i, t, _ in rows)))
    for r in found.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    ledger = pdf(found)
    for r in quality.ablations(found).collect():
        bit = 1 << [*quality.RULES].index(r.rule)
        assert r.failed == (ledger.failures & bit != 0).sum() and r.only == (ledger.failures == bit).sum()
    assert quality.ledger(no_docs).count() == 0


# 5 packing


def test_packing_round_trip(docs, rows, no_docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.public_path(packing.TOKENIZER))
    found = pdf(packing.pack_documents(docs, keep_ids=True))
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 2048
    want = Counter()
    for i, t, _ in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4").tobytes()
            want[str(i), k, s, len(part) // 4, zlib.crc32(part)] += 1
            assert any(x == part for x in found.ids)
    got = Counter((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == want
    assert packing.pack_documents(no_docs).count() == 0


def test_ids_of_odd_texts():
    from tokenizers import Tokenizer

    path = tokens.public_path(packing.TOKENIZER)
    tk, rnd = Tokenizer.from_file(path), random.Random(5)
    odd = ["<|ENDOFTEXT|> A", "<|endoftext|>x.", "É é́. ñ, Ǆ! ÅÅ? don't. I'LL! ß; ſ. ×. ÷! ª. µ,", "\x1c \x1f a\x1cb", "ΑΣ ΣΑΣ. Σ", "K. ﬁ!"]
    odd += ["".join(rnd.choice("aBÉé' th́ \n<|>é日\t.,!in \x1cΣ9Ȁ") for _ in range(rnd.randrange(60))) for _ in range(3000)]
    for text, got in zip(odd, packing.ids_of(path).batches([x.encode() for x in odd])):
        assert np.frombuffer(got, "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_workers_hold_few_words_and_texts(spark):
    from itertools import islice, product

    from lodeline.llm.common import text_batches

    words = ["".join(x) for x in islice(product("abcdefghijklm", repeat=5), 300_000)]
    coder = packing.Ids(tokens.public_path(packing.TOKENIZER))
    found = list(coder.batches([" ".join(words[at : at + 20_000]).encode() for at in range(0, len(words), 20_000)]))
    assert len(found) == 15 and all(found) and len(coder.index) < 250_000
    session = spark.newSession()
    text_batches(session.range(1))
    assert int(session.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_local_search_never_worse_and_whole():
    rnd = random.Random(4)
    for sizes in ([400, 650, 700, 900, 1024], range(1, 2048), [2047, 1, 2], [2048]):
        lengths = [rnd.choice([*sizes]) for _ in range(500)]
        best, packed = packing.best_fit([n for n in lengths if n < 2048], 2048), packing.pack_lengths(lengths)
        assert sorted(i for b in packed for i in b) == list(range(500)) and all(sum(lengths[i] for i in b) <= 2048 for b in packed)
        assert len(packed) <= len(best) + lengths.count(2048)
    assert packing.pack_lengths([]) == []


def test_exchange_dissolves_a_bin():
    bins, lengths = [[0, 1], [2, 3], [4]], [6, 3, 5, 4, 2]
    assert len(packing.local_search(bins, lengths, 10)) == 2


# 6 chat


CHAT = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hi <s>[INST] \\ </s>[/INST]"),
    (1, 2, "assistant", "</s>[INST] ok [/INST]\\"),
    (2, 1, "assistant", None),
    (2, 0, None, "no role"),
    (2, 1, "assistant", "tie"),
    (2, 1, "assistant", "tie"),
    (None, None, "user", "nowhere"),
    (None, 3, "assistant", "é日\n" * 50),
] + [(3, i, ("system", "user", "assistant")[0 if i == 0 else 1 + i % 2], f"turn {i} " + "w " * (i * 37 % 300)) for i in range(300)]


def slow_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[c] = (len(mine), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back(spark, sf_dir):
    df = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, window string")
    found = chat.windows(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(found).collect()}
    assert got == slow_chat(CHAT)
    frame = pdf(found)
    limit = chat.CELL + 310 + chat.HISTORY * chat.HISTORY_TOKENS + 20
    assert (frame.tokens <= limit).all() and len(frame[frame.conv_id == 3]) > 20
    assert frame[(frame.conv_id == 3)].formatted.str.startswith("<s>[INST]system[/INST]turn 0").all()
    assert (frame[(frame.conv_id == 3) & (frame.window > 0)].n_context >= 1).all()
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0
    conv = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    conv += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(spark, sf_dir).collect()}
    assert got == slow_chat(conv)


def test_chat_history_has_no_holes(spark):
    words = [3, 5, 200, 7, 300, 90, 350, 4, 6, 280, 20, 500, 9, 100, 110, 120, 130]
    roles = ["system", "user", "assistant", "system", *("user", "assistant") * 7]
    talk = [(1, i, r, f"t{i}x " + "w " * (n - 1)) for i, (r, n) in enumerate(zip(roles, words))]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    found = sorted(chat.windows(df).collect(), key=lambda r: r.window)
    budget, later = chat.HISTORY * chat.HISTORY_TOKENS, 0
    for r in found:
        held = [int(i) for i in re.findall(r"t(\d+)x", r.formatted)]
        first = held[r.n_context]
        want, total = [], 0
        for i in range(first - 1, max(-1, first - 1 - chat.HISTORY), -1):
            total += words[i] + chat.MARKERS
            if want and total > budget:
                break
            want.append(i)
        assert held[: r.n_context] == sorted({0, *want} if first else want), r.window
        later += first > 0
    assert later >= 4


def test_chat_windows_fit_the_budget(spark):
    rnd, talk = random.Random(12), []
    for conv in range(12):
        system = rnd.choice([0, 3, 120, 500, 900])
        turns_of = [("system", system)] * (system > 0) + [(("user", "assistant")[i % 2], rnd.choice([1, 20, 90, 200, 330, 380])) for i in range(60)]
        talk += [(conv, i, role, f"t{i}x " + "w " * (n - 1)) for i, (role, n) in enumerate(turns_of)]
    talk += [(50, 0, "system", "be kind"), (50, 1, "user", "w " * 5000), (50, 2, "assistant", "short"), (51, 0, "system", "s " * 2000), (51, 1, "user", "a"), (51, 2, "assistant", "b")]
    found = pdf(chat.windows(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")))
    longest = {c: max(len(t.split()) + chat.MARKERS for k, _, r, t in talk if k == c and r != "system") for c in range(12)}
    system = {c: sum(len(t.split()) + chat.MARKERS for k, _, r, t in talk if k == c and r == "system") for c in range(12)}
    checked = 0
    for r in found[found.conv_id < 12].itertuples():
        cell = max(64, min(384, (1408 - system[r.conv_id]) // 3, (1408 - 256 - system[r.conv_id]) // 2))
        checked += longest[r.conv_id] <= cell
        assert r.tokens <= chat.BUDGET + (longest[r.conv_id] > cell) * 2 * longest[r.conv_id], (r.tokens, cell)
        assert r.tokens <= chat.BUDGET or longest[r.conv_id] > cell
    assert checked > 50 and found[found.conv_id == 50].n_turns.sum() >= 3 and len(found[found.conv_id == 51]) >= 1


# 7 mixing


def test_targets_and_draws():
    assert mixing.targets([100, 100, 100]) == [200.0, 2 / 3 * 250, 1 / 3 * 250] or sum(mixing.targets([100, 100, 100])) == pytest.approx(450)
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []
    assert all(t <= 2 * s for t, s in zip(mixing.targets([5, 1000, 1]), [5, 1000, 1]))
    drawn = mixing.draw([10, 70_000, 0, 5], shard=1000)
    assert drawn.sum(axis=0).tolist() == [10, 70_000, 0, 5] and (drawn.sum(axis=1) <= 1000).all()
    assert mixing.draw([0, 0]).sum() == 0
    parts = [got for a in range(0, 71, 9) for _, got in mixing.draws([10, 70_000, 0, 5], a, a + 9, 1000)]
    assert (np.array(parts) == drawn).all()
    assert [before.tolist() for before, _ in mixing.draws([10, 70_000, 0, 5], 0, 71, 1000)] == (np.cumsum(drawn, axis=0) - drawn).tolist()
    for n in (1, 2, 3, 7, 100, 1023, 4096):
        assert sorted(mixing.permute(np.arange(n), n, 9)) == list(range(n))


def test_mixing_meets_targets(spark, sf_dir, docs, rows, no_docs):
    found = pdf(mixing.query(spark, sf_dir.replace("0.001", "0.01")))
    again = pdf(mixing.query(spark, sf_dir.replace("0.001", "0.01")))
    order = ["doc_id", "size", "taken"]
    assert found.sort_values(order).taken.tolist() == again.sort_values(order).taken.tolist()
    assert (found.taken <= 2 * found["size"]).all()
    by = found.merge(pd.read_parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")[["doc_id", "source"]], on="doc_id").groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), known=("source_size", "first"))
    assert (by["size"] == by.known).all() and ((by.taken - by.target).abs() <= 0.02 * by.target + 300).all()
    small = mixing.taken(docs, block=8)
    sizes = Counter(r["size"] for r in small.collect())
    assert sizes == Counter(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert all(r.taken <= 2 * r["size"] for r in small.collect())
    assert mixing.taken(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_places_in_permutations():
    for n in (1, 2, 3, 7, 100, 1023):
        places = mixing.permute(np.arange(n), n, 9)
        assert [mixing.place_of(int(b), n, 9) for b in places] == list(range(n))


def test_mixing_meets_small_quotas_to_the_word(make_docs):
    lengths = {"a": 1, "b": 63, "c": 100, "d": 150, "e": 191, "f": 128, "g": 5000, None: 40}
    made = [(i, " ".join(f"w{k}" for k in range(n)), s) for i, (s, n) in enumerate(lengths.items())]
    made += [(20 + i, " ".join("xyz" for _ in range(n)), "d") for i, n in enumerate((3, 200, 77))]
    docs = make_docs(made)
    source_of = {i: s for i, _, s in made}
    for block in (128, 8):
        taken, target, mixed = Counter(), {}, Counter()
        for r in mixing.taken(docs, block).collect():
            taken[source_of[r.doc_id]] += r.taken
            target[source_of[r.doc_id]] = r.target
        assert dict(taken) == {s: round(t) for s, t in target.items()} and all(taken.values())
        assert any(taken[s] == 2 * n for s, n in lengths.items()) and any(n < t < 2 * n for n, t in ((lengths[s], taken[s]) for s in "abcefg"))
        for r in mixing.mix(docs, block).collect():
            mixed[source_of[r.doc_id]] += len(r.text.split())
        assert mixed == taken


def test_mix_takes_the_words_it_says(docs, rows):
    words = Counter()
    for r in mixing.mix(docs, block=8).collect():
        assert r.n_chars == len(r.text) and r.fp == "clash"
        words[r.doc_id] += len(WORD.findall(r.text))
        whole = {t for i, t, _ in rows if i == r.doc_id}
        assert any(all(part in t for part in r.text.split("\n")) for t in whole if t)
    want = Counter()
    for r in mixing.taken(docs, block=8).collect():
        want[r.doc_id] += r.taken
    assert +want == words


# 8 URLs


def slow_verdict(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None))
    return host, path, best[1]


def test_url_rules_and_model(spark, sf_dir):
    odd = ["http://A.Com/x?y#z", "net/es/", None, "", "x://", "http://net/es/a", "http://notcom/", "HTTP://www.EXAMPLE.com/en/1", "http://example.com/en/", "http://example.com/en", "http://b.example.com/en/?q=://", "http://x.net/FR/", "http://x.net/fr/", "a://b?c/d", "http://com", "http://ü.com/é"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(odd)], "page_id long, url string, host string")
    for r in urls.judge(df).collect():
        host, path, rule = slow_verdict(odd[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), odd[r.page_id]
        want = {h + p: v for v, h, p in urls.RULES}.get(rule) or ("block" if r.score > 0.5 else "allow")
        assert r.verdict == want
    assert urls.judge(df.limit(0)).count() == 0
    held = pdf(urls.judge(table(spark, sf_dir.replace("0.001", "0.1"), "pages")))
    bad = held.host.str.contains("spam-farm|cheap-pills|ads-track|casino-win|free-bets|adult-x")  # none is in the labelled table
    assert not set(held.host) & {h for h, _, _ in urls.labelled_urls()}
    assert not {w for w in urls.BAD_HOSTS if w in "spam-farm cheap-pills ads-track casino-win free-bets adult-x".split()}
    assert ((held.score > 0.5) == bad).mean() > 0.99 and (held.score[bad] > 0.5).mean() > 0.95


def slow_score(host, path):
    grams = {zlib.crc32(x[i : i + n], seed) % 65536 for seed, x in ((0, f"^{host}$".encode()), (1, f"^{path}$".encode())) if len(x) > 2 for n in (3, 4, 5) for i in range(len(x) - n + 1)}
    w, bias = urls.train()
    return 1 / (1 + np.exp(-(sum(w[g] for g in grams) / len(grams) ** 0.5 + bias))) if grams else 0.0


def test_url_scores_equal_a_plain_sum_and_defined_cases(spark):
    odd = [(1, "http://a.org/casino/x"), (1, "http://a.org/casino/x"), (None, "https://ü.example/é?q"), (2, "http://" + "long-host." * 3000 + "org/" + "p/" * 20_000), (3, "http://x"), (4, None)]
    found = urls.judge(spark.createDataFrame(odd, "page_id long, url string")).collect()
    assert len(found) == len(odd) and sum(r.page_id is None for r in found) == 1
    for r in found:
        assert r.score == pytest.approx(slow_score(r.host, r.path)) and r.verdict == ("block" if r.score > 0.5 else "allow")


def test_url_model_learns_paths_and_unseen_hosts():
    """Every fourth name of the table held out, under all its hosts, and paths that alone tell."""
    rows = urls.labelled_urls()
    name = lambda h: next(p for p in h.split(".") if p not in ("www", "blog", "m"))
    out = {*urls.BAD_HOSTS[::4], *urls.GOOD_HOSTS[::4]}
    model = urls.fit([r for r in rows if name(r[0]) not in out])
    judged = [(urls.score(h, p, model) > 0.5) == bool(y) for h, p, y in rows if name(h) in out]
    assert np.mean(judged) > 0.85
    assert urls.score("neutral.example.org", "/casino/bonus-bets/free-pills") > 0.5 > urls.score("neutral.example.org", "/articles/history-of-gardens")


# 9 lines


M64 = (1 << 64) - 1


def slow_mix(x):
    for _ in range(2):
        x = (x ^ x >> 32) * int(lines.ODD) & M64
    return x ^ x >> 32


def slow_words(norm):
    """(hash, bytes) of the words of a normalised line; three-byte ideographs and syllables are words."""
    out = []
    for run in norm.split():
        at = [0, *(i for i in range(1, len(run)) if 0xE3 <= run[i] <= 0xED), len(run)]
        for word in (run[a:b] for a, b in zip(at, at[1:])):
            h = slow_mix(int.from_bytes(word[:8], "little") + len(word) * int(lines.STEP) & M64)
            for k in range(8, len(word), 8):
                h = slow_mix(h * int(lines.STEP) + int.from_bytes(word[k : k + 8], "little") & M64)
            out.append((h, len(word)))
    return out


def slow_keys(line):
    """The keys of a line's blocks and of all its words but one, one bit after the other."""
    words, keys = slow_words(lines.normalised(line)), set()
    pairs = {(slow_mix(a[0] * 3 + b[0] & M64) >> 26, min(a[1] + b[1], 63)) for a, b in zip(words, words[1:])}
    if len(pairs) >= 6:
        for n in {len(pairs), int(len(pairs) * 1.25)}:
            level = max(k for k in range(40) if 1.5 * 2**k <= n)
            for number in range(min(16, 1 << level)):
                mine = [p for p in pairs if p[0] >> 38 - level == number]
                if sum(p[1] for p in mine) >= (18 if level > 3 else 12):
                    hashes = [slow_mix(p[0] + 1) for p in mine]
                    block = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
                    keys.add(slow_mix(block + (number * 64 + level) * int(lines.STEP) & M64))
    if 2 <= len(words) <= 16:
        total = sum(w[1] for w in words)
        for skip in [None, *range(len(words))]:
            if skip is None or (total - words[skip][1] >= 12 and 2 * words[skip][1] <= total):
                rest = [w[0] for i, w in enumerate(words) if i != skip]
                keys.add(slow_mix(sum(h * pow(int(lines.STEP), i, 1 << 64) for i, h in enumerate(rest)) & M64))
    return keys


def slow_line_groups(texts):
    """Removed lines per text by all pairs."""
    places, norms, keys = [], [], []
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").encode().split(b"\n")):
            if norm := lines.normalised(line):
                places.append((i, k)), norms.append(norm.decode()), keys.append(slow_keys(line))
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(places)):
        for j in range(i):
            if norms[i] == norms[j] or (keys[i] & keys[j] and slow_similar(norms[i], norms[j])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {p for i, p in enumerate(places) if find(i) != i}


def slow_similar(a, b):
    return slow_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_line_keys_equal_a_plain_count(monkeypatch):
    rnd = random.Random(9)
    odd = ["", "...", "a", "Ab 日本語のテキスト、です xyz", "x" * 700, "é " * 40, "one two", "0 1 2 3 4 5 6 7 8 9", "the the the the the the the the the"]
    made = odd + [" ".join(rnd.choice("abcdefghij") * rnd.randrange(1, 90) for _ in range(rnd.choice([0, 1, 3, 12, 17, 40, 200]))) for _ in range(60)]
    data = "\n".join([*made, ""]).encode().translate(lines.TO)
    whole = lines.keyed_lines(data)
    for i, line in enumerate(made):
        assert set(whole[1][whole[2] == i].tolist()) == slow_keys(line.encode()), line[:80]
    assert [bool(h) for h in whole[0].tolist()] == [bool(lines.normalised(x.encode())) for x in made]
    assert len(set(whole[0].tolist())) == len({lines.normalised(x.encode()) for x in made})
    assert lines.keyed_lines("日 本\n日本\n".encode())[0].tolist() != lines.keyed_lines("日本\n日本\n".encode())[0].tolist()
    monkeypatch.setattr(lines, "PIECE", 800)
    monkeypatch.setattr(lines, "LINE_BITS", 3)
    for a, b in zip(whole, lines.keyed_lines(data)):
        assert (np.sort(a) == np.sort(b)).all()
    sizes = np.array([1, 300, 5, 700, 255, 256, 2])
    many = np.random.default_rng(1).integers(0, 1 << 64, sizes.sum(), np.uint64)
    want, at = [], 0
    for n in sizes.tolist():
        part, at = many[at : at + n].tolist(), at + n
        want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in part) > n))
    assert lines.simhashes(many, sizes, chunk=100).tolist() == lines.simhashes(many, sizes).tolist() == want


@pytest.mark.parametrize("edit", ["replace", "insert", "letter", "several"])
def test_line_recall_by_length(edit):
    """Pairs with edit similarity of 0.8 and more that share a key, by length: 0.9 at least."""
    rnd, word = random.Random(7), lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 10)))
    for n in (6, 8, 12, 20, 50, 100, 200):
        hits = total = 0
        while total < 150:
            ws = [word() for _ in range(n)]
            other = [*ws]
            for _ in range(max(1, n // 12) if edit == "several" else 1):
                k = rnd.randrange(n)
                other[k : k + (edit != "insert")] = [ws[k][:-1] + "x" if edit == "letter" else word()]
            a, b = " ".join(ws), " ".join(other)
            if a != b and lines.similar(a, b):
                total += 1
                hits += bool(slow_keys(a.encode()) & slow_keys(b.encode()))
        assert hits >= 0.9 * total, (edit, n, hits, total)


def test_line_recall_on_documents(sf_dir):
    """All pairs of lines of the smallest documents by edit similarity alone."""
    texts = pd.read_parquet(f"{sf_dir}/documents.parquet").text.dropna()
    norms = sorted({lines.normalised(x.encode()) for t in texts for x in t.split("\n")} - {b""}, key=len)
    keys = [slow_keys(x) for x in norms]
    hits = total = 0
    for i, a in enumerate(norms):
        for j in range(i + 1, len(norms)):
            if 0.8 * len(norms[j]) > len(a):
                break
            shared = bool(keys[i] & keys[j])
            if (shared or len({*a.split()} & {*norms[j].split()}) >= len(a.split()) / 3) and lines.similar(a.decode(), norms[j].decode()):
                total, hits = total + 1, hits + shared
    assert total >= 20 and hits >= 0.9 * total, (hits, total)


def test_normal_form_as_a_column(spark):
    odd = ["A-b  C", " 12 x9!", "É日本 Ⅷ", "\x00\x7f~{}[]`@:;", "", "tab\there\r", "no change"]
    from pyspark.sql import functions as F

    found = spark.createDataFrame([(x,) for x in odd], "x string").select("x", lines.normal_form(F.col("x")).alias("y")).collect()
    assert all(r.y == lines.normalised(r.x.encode()).decode() for r in found)


def test_edit_distance():
    rnd = random.Random(6)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abé") for _ in range(rnd.randrange(14))) for _ in "ab")
        most = rnd.randrange(14)
        d = slow_distance(a, b)
        assert min(lines.edit_distance(a, b, most), most + 1) == min(d, most + 1), (a, b, most)
        assert lines.distances(a, [b, a, "", b + "é"]) == [d, 0, len(a), slow_distance(a, b + "é")]
        x, y = (" ".join(rnd.choice(["ab", "c", "déf", "gh"]) for _ in range(rnd.randrange(9))) for _ in "xy")
        assert lines.bounded_above(x.split(), y.split()) >= slow_distance(x, y)
        assert lines.similar(x, y) == slow_similar(x, y)


def test_lines_equal_brute_force(make_docs):
    rnd = random.Random(8)
    vocabulary = [f"w{i:x}{i * 7 % 31:x}" for i in range(60)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 60, 90]))) for _ in range(25)]
    texts = []
    for _ in range(40):
        some = [rnd.choice(base) for _ in range(rnd.randrange(6))]
        for k, line in enumerate(some):
            ws = line.split()
            for _ in range(rnd.randrange(3)):
                ws[rnd.randrange(len(ws))] = rnd.choice(vocabulary)
            some[k] = rnd.choice([" ", "  "]).join(ws) + rnd.choice(["", ".", "!"])
        texts.append("\n".join([*some, "..."]))
    texts = [*dict.fromkeys(texts)]
    gone = slow_line_groups(texts)
    assert len(gone) > 20
    found = lines.dedup_lines(make_docs([(i, t, "s") for i, t in enumerate(texts)]), counts=True).collect()
    for r in found:
        want = "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == want and r.n_chars == len(want)


def test_lines_with_one_edit_by_edit_similarity_alone(make_docs):
    rnd = random.Random(3)
    pairs = []
    for _ in range(150):
        ws = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(50, 100))]
        other = [*ws]
        other[rnd.randrange(len(ws))] += "x"
        pairs.append((" ".join(ws), " ".join(other)))
    texts = [t for pair in pairs for t in pair]
    assert all(lines.similar(a, b) for a, b in pairs)
    left = sum(bool(r.text) for r in lines.dedup_lines(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect())
    assert len(texts) - left >= 0.85 * len(pairs)  # radius 3: about half


def test_failed_links_are_searched_again(spark, make_docs):
    # one fingerprint, texts in other orders: the star's links fail, a later pair holds
    ws = [c * 6 for c in "abcdefghijklmnopqrstuvwxyz"]
    a, b = " ".join(ws), " ".join(ws[::-1])
    c = " ".join([*ws[:1:-1], ws[0], ws[1]])
    for texts in ([a, b, c], [b, a, c], [c, b, a]):
        got = {r.doc_id: r.text for r in lines.dedup_lines(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect()}
        gone = slow_line_groups(texts)
        assert {i for i, t in got.items() if not t} == {i for i, _ in gone} and len(gone) == 1


def test_dense_blocks_give_few_links(spark, monkeypatch):
    """Lines that share blocks but little text: links stay few, and parts of a block find what the whole finds."""
    rnd = random.Random(11)
    passage = " ".join(f"common{i}" for i in range(12))
    made = [f"{passage} " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(14)) for _ in range(40)]
    made += [x + " more" for x in made[:12]]
    labels = np.arange(len(made))
    found = lines.across(made, labels, np.zeros(len(made), int), -1)
    assert len(found) == 12 and {(a, b) for a, b in found} == {(i, 40 + i) for i in range(12)}
    near = [passage + f" x{i}" for i in range(200)]
    assert len(lines.across(near, np.arange(200), np.zeros(200, int), -1)) == 199
    orders = [" ".join(rnd.sample([c * 5 for c in "abcdefghijklmnopqrst"], 20)) for _ in range(2000)]
    keys = Counter(k for x in orders for k in slow_keys(x.encode()))
    assert sum(n * (n - 1) // 2 for n in keys.values()) < 2000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    want = {i for i, _ in slow_line_groups(made)}
    for chunk in (lines.CHUNK, 10):
        monkeypatch.setattr(lines, "CHUNK", chunk)
        assert {r.doc_id for r in lines.dedup_lines(docs).collect() if not r.text} == want and len(want) >= 12


def test_a_line_meets_a_large_group_side_by_side(monkeypatch):
    """A lone line beside a large group is compared with many at a time, and hopeless comparisons stop early with the same verdicts."""
    rnd, calls, real = random.Random(4), [], lines.similar
    made = [" ".join(["common words of one passage"] * 4) + f" x{i}" for i in range(60)]
    lone = "".join(rnd.choice("mnopqrst ") for _ in range(len(made[-1])))
    monkeypatch.setattr(lines, "similar", lambda a, b: calls.append(1) or real(a, b))
    assert lines.across([*made, lone], np.array([0] * 60 + [60]), np.zeros(61, int), -1) == [] and len(calls) <= 1
    assert lines.across([*made, made[0] + "y"], np.array([0] * 60 + [60]), np.zeros(61, int), -1) != []
    for _ in range(300):
        a = "".join(rnd.choice("abcé") for _ in range(rnd.choice([32, 50])))
        others = ["".join(rnd.choice("abc") if rnd.random() < share else c for c in a) for share in (0.1, 0.3, 0.9)] + ["", "abc"]
        limits = np.array([rnd.randrange(25) for _ in others])
        for exact, found, most in zip(lines.distances(a, others), lines.distances(a, others, limits), limits.tolist()):
            assert found == exact or min(found, exact) > most


def test_pairs_are_judged_together_as_one_by_one(monkeypatch):
    """Columns of many pairs at a time give the verdicts of plain distances, at every length and over words of 64 rows."""
    rnd, pairs = random.Random(5), []
    for _ in range(700):
        a = "".join(rnd.choice("abcdé日 ") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 128, 130, 300])))
        share = rnd.choice([0.02, 0.1, 0.2, 0.3, 0.9])
        b = "".join(rnd.choice(["", "x", "ab", "c"]) if rnd.random() < share else c for c in a)
        pairs.append((a, b) if rnd.random() < 0.5 else (b, a))
    limits = np.array([max(lines.most_edits(a, b), abs(len(a) - len(b))) for a, b in pairs])
    want = [slow_distance(a, b) <= most for (a, b), most in zip(pairs, limits.tolist())]
    assert 100 < sum(want) < 600
    for long in (lines.LONG, 100):
        monkeypatch.setattr(lines, "LONG", long)
        assert lines.within(pairs, limits).tolist() == want
    assert lines._columns(pairs, limits).tolist() == want


def test_long_lines_compare_together_in_narrow_bands(monkeypatch):
    rnd, plain, pairs = random.Random(12), lines.edit_distance, []
    for i in range(120):
        a = "".join(rnd.choice("abcde ") for _ in range(rnd.randrange(2200, 2600) if i % 2 else rnd.randrange(60, 200)))
        cut, edits = rnd.choice([0, len(a) // 10, len(a) // 5, len(a) // 4]), rnd.randrange(1 + len(a) // 8)
        b = list(rnd.choice([a[cut:], a[: len(a) - cut], a[: len(a) // 2] + a[len(a) // 2 + cut :]]))
        for _ in range(edits):
            b[rnd.randrange(len(b))] = rnd.choice("abcde ")
        pairs.append(rnd.choice([(a, "".join(b)), ("".join(b), a)]))
    limits = np.array([lines.most_edits(a, b) for a, b in pairs])
    pairs, limits = zip(*[(p, n) for p, n in zip(pairs, limits, strict=True) if abs(len(p[0]) - len(p[1])) <= n], strict=True)
    want = [plain(a, b, n) <= n for (a, b), n in zip(pairs, limits, strict=True)]
    assert {*want} == {True, False}
    monkeypatch.setattr(lines, "edit_distance", None)  # one at a time costs about ten times as much
    assert lines.within([*pairs], np.array(limits)).tolist() == want


def test_pairs_of_all_lengths_are_judged_side_by_side(monkeypatch):
    """Few pairs of each length need no comparison of their own, and lanes that are given anew keep their verdicts."""
    rnd, plain, pairs = random.Random(21), lines.edit_distance, []
    for i in range(90):
        a = "".join(rnd.choice("abcdefé日 ") for _ in range(100 + 40 * i))
        share = rnd.choice([0.05, 0.17, 0.2, 0.24, 0.6])
        b = "".join(rnd.choice(["", "x", "ab", "c"]) if rnd.random() < share else c for c in a)
        pairs.append(rnd.choice([(a, b), (b, a)]))
    limits = np.array([max(lines.most_edits(a, b), abs(len(a) - len(b))) for a, b in pairs])
    want = [plain(a, b, n) <= n for (a, b), n in zip(pairs, limits.tolist())]
    assert 20 < sum(want) < 80
    monkeypatch.setattr(lines, "edit_distance", None)
    for abreast, room in ((lines.ABREAST, lines.ROOM), (7, lines.ROOM), (lines.ABREAST, 1 << 14)):
        monkeypatch.setattr(lines, "ABREAST", abreast)
        monkeypatch.setattr(lines, "ROOM", room)
        assert lines.within(pairs, limits).tolist() == want


def test_repeated_lines_are_cut_into_blocks_once(monkeypatch):
    """Only lines that a task meets anew are given keys, those of keyed_lines(); fetched lines have the ledger's normal form."""
    cut, real = [], lines.blocks
    monkeypatch.setattr(lines, "blocks", lambda words, sizes, counts, *rest: cut.append(int((counts > 0).sum())) or real(words, sizes, counts, *rest))
    text = "\n".join(" ".join(f"{c}{i}word" for i in range(20)) for c in "xy").encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([7, 7, 7]), pa.array([text, text, b"...\n" + text])], names=[*"abc"])
    packet = [x for b in lines._write_ledger(iter([batch])) for x in b.column(3).to_pylist() if x]
    keys = lines.keyed_lines(text.translate(lines.TO) + b"\n", True)[1]
    assert cut[0] == 2 and len(packet) == 1 and packet[0][:4] == b"\2\0\0\0"
    assert sorted(np.frombuffer(packet[0], "<u8", -1, 4 + 12 * 2).tolist()) == sorted(keys.tolist())
    odd = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["A-b  É 12!".encode(), b""])], names=[*"ab"])
    assert next(lines._normalise(iter([odd]))).column(1).to_pylist() == ["a b É 00".encode(), b""]


def test_lines_that_share_keys_are_compared_once(monkeypatch):
    """Two lines that share several keys are compared for the least of them, and in no other task."""
    calls, real = [], lines.within
    monkeypatch.setattr(lines, "within", lambda pairs, limits: calls.extend(pairs) or real(pairs, limits))
    rnd = random.Random(2)
    made = ["".join(rnd.choice("abcdefgh ") for _ in range(90)) for _ in range(3)]
    made.append(made[2] + "x")
    for few in (lines.FEW_LINES, 1):
        monkeypatch.setattr(lines, "FEW_LINES", few)
        rows = [(k, 0, 0, 0, h, -1, h, x, list(range(k))) for k in range(4) for h, x in enumerate(made)]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)][:8] + [pa.array([r[8] for r in rows], pa.list_(pa.int64()))], names=[*"abcdefghi"])
        calls.clear()
        found = [sorted(x) for b in lines._across(iter([batch])) for x in zip(*b.to_pydict().values())]
        assert found == [[2, 3]] and len(calls) == 6


def test_lines_that_agree_only_beyond_the_first_blocks(make_docs):
    """Pairs of 0.8 and more that share none of keyed_lines' own keys: edits in each of a long line's first blocks, one long word."""
    rnd, word = random.Random(12), lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(6, 10)))
    pairs = []
    while len(pairs) < 3:
        ws = [word() for _ in range(400)]
        level = max(k for k in range(40) if 1.5 * 2**k <= len(ws) - 1)
        at = [(slow_mix(slow_words(a.encode())[0][0] * 3 + slow_words(b.encode())[0][0] & M64) >> 64 - level) for a, b in zip(ws, ws[1:])]
        other = [*ws]
        for number in range(16):
            for k in [i for i, x in enumerate(at) if x == number][:1]:
                other[k] = ws[k][:-1] + "z"
        a, b = " ".join(ws), " ".join(other)
        if not slow_keys(a.encode()) & slow_keys(b.encode()):
            pairs.append((a, b))
    long = "".join(rnd.choice("abcdefghijklmnop") for _ in range(60))
    pairs.append((long, long[:20] + "zz" + long[21:50] + long[51:]))
    assert all(lines.similar(a, b) and not slow_keys(a.encode()) & slow_keys(b.encode()) for a, b in pairs)
    texts = [t for pair in pairs for t in pair]
    kept = {r.doc_id for r in lines.dedup_lines(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect() if r.text}
    assert kept == {2 * i for i in range(len(pairs))}


def test_lines_beyond_the_broadcast_limit_are_not_sorted(make_docs, monkeypatch):
    """Where the wanted and the marked lines are too many to broadcast, all lines meet them in hash tables and give one place each without a sort."""
    rng, words = random.Random(7), [f"w{i}rd" for i in range(300)]
    texts = ["\n".join(" ".join(rng.choices(words, k=12)) for _ in range(6)) for _ in range(30)]
    texts += [t.replace("w1", "v1", 1) for t in texts[:20]]
    docs, plans = make_docs([(i, t, "s") for i, t in enumerate(texts)]), []
    want = sorted(map(tuple, lines.dedup_lines(docs, counts=True).collect()))
    monkeypatch.setattr(lines.small, "__defaults__", (0, *lines.small.__defaults__[1:]))
    real = lines.checkpoint

    def spy(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df)

    monkeypatch.setattr(lines, "checkpoint", spy)
    assert sorted(map(tuple, lines.dedup_lines(docs, counts=True).collect())) == want and any(r[-1] for r in want)
    places = [p for p in plans if "collect_list(" in p and "first(" in p]
    assert len(places) == 1 and "SortAggregate" not in places[0] and "ShuffledHashJoin" in places[0]
    assert sum("ShuffledHashJoin [h" in p for p in plans) == 2 and sum("ShuffledHashJoin [root" in p for p in plans) == 1


def test_lines_defined_cases(docs, rows, no_docs):
    found = lines.dedup_lines(docs, counts=True)
    assert found.columns == [*docs.columns, "__lines", "__removed"]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in found.collect())
    by = {}
    for i, t in got:
        by.setdefault(i, []).append(t)
    assert by[3] == ["", ""] and by[7] == ["one\nTwo three\n---\n---"] and by[11] == [""] and by[6] == [" \n\t "] and by[4] == [""]
    assert len(got) == len(rows) and lines.dedup_lines(no_docs).count() == 0


# 10 media


def slow_feature(payload):
    """Sizes, average and difference hashes of an 8 x 9 reduction and a digest, by plain loops."""
    rows = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    cells = lambda n, k: [(i * n // k, max((i + 1) * n // k, i * n // k + 1)) for i in range(k)]
    small = [[sum(sum(r[c0:c1]) for r in rows[r0:r1]) / ((r1 - r0) * (c1 - c0)) for c0, c1 in cells(192, 9)] for r0, r1 in cells(len(rows), 8)]
    mean = np.mean([r[:8] for r in small])
    average = np.packbits([x > mean for r in small for x in r[:8]]).tobytes().hex()
    difference = np.packbits([b > a for r in small for a, b in zip(r, r[1:])]).tobytes().hex()
    frames = [rows[i : i + 8191] for i in range(0, len(rows), 8191)]
    return "+".join(f"1536x{8 * len(f)}" for f in frames) + f"*{len(frames)}:{average}:{difference}:{hashlib.md5(payload).hexdigest()[:16]}"


def test_media_round_trip(docs, rows, no_docs):
    found = media.read_back(media.store(docs))
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t)
    for r in found.collect():
        data = (texts[r.doc_id] or "").encode() if r.doc_id is not None else None
        if data is None:
            continue
        payload = data + b" " * (192 if not data else -len(data) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media_bytes = media.encode(payload)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media_bytes), hashlib.sha256(media_bytes).hexdigest(), slow_feature(payload))
    assert media.read_back(media.store(no_docs)).count() == 0


def test_media_general_decoder_and_frames():
    rnd = np.random.default_rng(1)
    payload = rnd.integers(0, 256, 192 * 40, np.uint8).tobytes()
    jpeg = media.encode(payload)
    fast, sizes = media.decode(jpeg)
    assert fast[0].tobytes() == payload and sizes == [(1536, 320)]
    fixed, media._fixed_width = media._fixed_width, lambda *a: None
    try:
        slow, _ = media.decode(jpeg)
    finally:
        media._fixed_width = fixed
    assert (slow[0] == fast[0]).all()
    big = bytes(192 * (media.FRAME_ROWS + 3))
    thumbs, sizes = media.decode(media.encode(big))
    assert len(thumbs) == 2 and b"".join(t.tobytes() for t in thumbs) == big


def test_media_feature_covers_all_frames():
    first, later = np.arange(99, dtype=np.uint8).reshape(9, 11), np.full((9, 5), 7, np.uint8)
    other = later.copy()
    other[:, 3:] = 250
    one, two = (media.feature([first, x], [(88, 72), (40, 72)]).split(":") for x in (later, other))
    assert one[0] == "88x72+40x72*2" and one[1] != two[1] and one[2] != two[2]
    assert media.feature([first], [(88, 72)]).startswith("88x72*1:")


def standard_jpeg(interval):
    """A 2-component-sampled colour scan written by hand with wide tables, AC terms and restarts."""
    bits = []
    dc = {s: (i, 4) for i, s in enumerate(range(12))}
    ac = {0x00: (0, 2), 0x01: (1, 2), 0xF0: (2, 2), 0x12: (6, 3)}

    def put(value, n):
        bits.extend(value >> k & 1 for k in range(n - 1, -1, -1))

    rnd, luma = random.Random(2), np.zeros((4, 4), int)
    out, last = b"", [0, 0, 0]
    for mcu in range(4):
        if interval and mcu and mcu % interval == 0:
            bits += [1] * (-len(bits) % 8)
            out += np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00") + bytes([0xFF, 0xD0 + (mcu // interval - 1) % 8])
            bits.clear()
            last = [0, 0, 0]
        for comp, n in ((0, 4), (1, 1), (2, 1)):
            for k in range(n):
                value = rnd.randrange(-100, 100)
                d, last[comp] = value - last[comp], value
                size = abs(d).bit_length()
                put(*dc[size])
                put(d if d > 0 else d + (1 << size) - 1, size) if size else None
                put(*ac[0xF0]), put(*ac[0x12]), put(2, 2), put(*ac[0x00])
                if comp == 0:
                    luma[mcu // 2 * 2 + k // 2, mcu % 2 * 2 + k % 2] = value
    bits += [1] * (-len(bits) % 8)
    out += np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0]) + bytes([16] * 64)) + seg(0xC0, bytes([8, 0, 32, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)])) + seg(0xC4, bytes([0x10, 0, 3, 1, *[0] * 13, 0x00, 0x01, 0xF0, 0x12]))
    if interval:
        head += seg(0xDD, bytes([0, interval]))
    return head + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + out + b"\xff\xd9", luma


@pytest.mark.parametrize("interval", [0, 1, 2])
def test_media_colour_scan(interval):
    jpeg, luma = standard_jpeg(interval)
    thumbs, sizes = media.decode(jpeg)
    assert sizes == [(32, 32)]
    assert (thumbs[0] == np.clip((luma * 16 + 4 >> 3) + 128, 0, 255)).all()
