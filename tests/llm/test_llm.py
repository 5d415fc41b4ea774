"""Operators on text: brute force, round trip, held-out accuracy and edge cases."""

import random
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import abuse, leakage, mixing
from tidemark.llm.text import words

ITEM = "Suppose the Grisholm archive lists 180 closed candles for AVAXUSDT and 618 that never arrived, so that the parent digest differs at position 864. Decide if the veto was proportionate and quote the threshold that applies? Key: the fork at revision 28 is void and its 259 descendants inherit nothing."
OTHER = "Consider a volume profile from Fennick in which bin 27 carries 39.5% of all contracts, and the cost model doubles once turnover exceeds 26 lots. Estimate how many revisions separate the root from the deepest leaf? Verdict: admissible with a penalty of 0.59, never with full weight."
FILLER = "the watchdog restarted overnight and nobody signed the record because the page was empty " * 5


def test_words():
    assert words("<p>The&nbsp;**Gap**</p> of 2.99, at 12:19 inter​val, dou-\n> ble 57.1%") == ["the", "gap", "of", "2.99", "at", "12:19", "interval", "double", "57.1%"]
    assert words(None) == [] and words("") == []


def test_leaks(spark):
    ws = ITEM.split()
    docs = [
        (1, FILLER + ITEM + FILLER), (2, FILLER + ITEM.upper().replace(" ", "  \n> ")), (3, " ".join(ws[:20])), (4, " ".join(ws[: int(len(ws) * 0.7)]) + FILLER),
        (5, ITEM.replace("180", "77").replace("618", "5").replace("Grisholm", "Velmora")), (6, FILLER * 40 + " ".join(w if i % 9 else "changed" for i, w in enumerate(ws))),
        (7, None), (8, ""), (9, "a"), (1, FILLER + ITEM + FILLER), (10, " ".join(reversed(ws))), (11, ITEM + OTHER),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, words string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, "too short"), (1, ITEM)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leakage.find_leaks(d, items).collect()}
    assert {k for k, r in got.items() if r["coverage"] >= leakage.LEAK} == {(1, 1), (2, 1), (4, 1), (5, 1), (6, 1), (11, 1), (11, 2)}
    assert got[5, 1]["slots"] < got[1, 1]["slots"] == 1.0
    assert leakage.find_leaks(d.limit(0), items).count() == 0 and leakage.find_leaks(d, items.limit(0)).count() == 0


def test_short_items(spark):
    d = spark.createDataFrame([(1, "see the too short note"), (2, "a nothing here"), (3, "one two x three and four five"), (4, "one three five")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "too short"), (2, "zebra"), (3, "one two three four five"), (4, "")], "item_id long, text string")
    got = leakage.find_leaks(d, items).filter("coverage >= 0.6").select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == {(1, 1), (3, 3), (4, 3)}


def test_recall_of_changed_copies(spark):
    """Copies in which every k-th word, or words at random, are changed, against the plain longest passage."""
    rnd = random.Random(3)
    pool = [f"w{i}" for i in range(600)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(20, 60)))) for i in range(20)]
    docs, kept = [], {}
    for i, t in items:
        ws = t.split()
        for k in (3, 4, 5, 6, 8):
            kept[len(docs), i] = 1 - len(range(k - 1, len(ws), k)) / len(ws)
            docs.append((len(docs), FILLER + " ".join("changed" if j % k == k - 1 else w for j, w in enumerate(ws)) + " " + FILLER))
        for share in (0.62, 0.7, 0.8):
            stay = set(rnd.sample(range(len(ws)), int(len(ws) * share) + 1))
            kept[len(docs), i] = len(stay) / len(ws)
            docs.append((len(docs), FILLER + " ".join(w if j in stay else "changed" for j, w in enumerate(ws)) + " " + FILLER))
        ws2 = ws[: len(ws) // 3] + ws[len(ws) // 2 :]  # a part torn out
        kept[len(docs), i] = len(ws2) / len(ws)
        docs.append((len(docs), FILLER + " ".join(ws2)))
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.filter("coverage >= 0.6").collect()}
    want = {k for k, share in kept.items() if share >= 0.6}
    missed = {k: kept[k] for k in want - found}
    assert all(d in {a for a, _ in kept} for d, _ in found) and len(want) > 150 and not missed, missed


def test_common_equals_dynamic_programme():
    rnd = random.Random(5)
    for _ in range(40):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leakage._common(leakage._bits(a), len(a), b) == t[-1][-1]


def test_permutation_and_draws():
    for size in (1, 2, 7, 100):
        got = mixing.permuted(np.arange(size), size, 3)
        assert sorted(got) == list(range(size)) and [mixing._position(int(x), size, np.uint64(3)) for x in got] == list(range(size))
    quotas = [100, 37, 180]
    whole = mixing.draw_counts(0, 5, 317, 64, quotas, 0)
    assert [r for i in range(5) for r in mixing.draw_counts(i, i + 1, 317, 64, quotas, 0)] == whole
    assert np.sum([n for _, n, _ in whole], axis=0).tolist() == quotas and [sum(n) for _, n, _ in whole] == [64, 64, 64, 64, 61]
    assert [b for _, _, b in whole][-1] == [q - n for q, n in zip(quotas, whole[-1][1])]
    rng = np.random.default_rng(1)
    far = [mixing._hypergeometric(rng, 6 * 10**9, 4 * 10**9, 10**9) for _ in range(50)]
    assert abs(np.mean(far) - 6 * 10**8) < 20_000 and 5_000 < np.std(far) < 40_000


@pytest.mark.skipif(not Path(mixing.TOKENIZER).exists(), reason="no vocabulary files")
def test_mixture(spark):
    rnd = random.Random(6)
    docs = [(i, rnd.choice(["a", "a", "a", "b"]), " ".join(rnd.choice(["gap", "bar", "sweep", "candle"]) for _ in range(rnd.randrange(5, 80)))) for i in range(400)]
    docs += [(900, "c", "unlisted source"), (901, None, "no source"), (902, "a", None), (903, "a", "")]
    d = spark.createDataFrame([(i, s, t, 1) for i, s, t in docs], "doc_id long, source string, text string, tokens int")
    blocks = mixing.pack_blocks(d, block=16).collect()
    key = lambda rows: sorted((r["source"], r["block_id"], r["n_tokens"], r["doc_ids"], r["tokens"]) for r in rows)
    assert key(blocks) == key(mixing.pack_blocks(d.repartition(7), block=16, bucket_docs=3).collect())
    enc = mixing._encoding(mixing.TOKENIZER)
    for s in "ab":
        own = [r for r in blocks if r["source"] == s]
        assert sorted(r["block_id"] for r in own) == list(range(len(own)))
        assert sum(r["n_tokens"] for r in own) == sum(len(enc.encode_ordinary(t)) for _, x, t in docs if x == s and t)
        assert all(r["n_tokens"] == len(r["tokens"]) <= 16 for r in own) and sum(r["n_tokens"] < 16 for r in own) <= 1
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("gone", 0.2, 1)], "source string, target_share double, repeat_cap int")
    rows, shares = mixing.mixture(d, targets, block=16, slots=8)
    got = {r["source"]: r for r in shares.collect()}
    assert got["gone"]["reached_share"] == 0 and abs(got["a"]["reached_share"] - 0.625) < 0.02 and got["a"]["max_repeats"] <= 2 and got["b"]["max_repeats"] <= 3
    out = rows.collect()
    assert len(out) == sum(r["blocks_used"] for r in got.values()) and len({(r["shard"], r["slot"]) for r in out}) == len(out)
    none = mixing.mixture(d.limit(0), targets, block=16, slots=8)
    assert none[0].count() == 0 and none[1].filter("reached_share > 0").count() == 0


def test_shares_are_of_tokens(spark):
    # the rare source's last block is short, which weighs as it has two blocks only
    d = spark.createDataFrame([("big", i, 128) for i in range(4000)] + [("rare", 0, 128), ("rare", 1, 40)], "source string, block_id long, n_tokens int")
    targets = spark.createDataFrame([("big", 0.9, 2), ("rare", 0.1, 3)], "source string, target_share double, repeat_cap int")
    out, shares = mixing.mix(d, targets, slots=64)
    got = {r["source"]: r for r in shares.collect()}
    assert got["rare"]["tokens_used"] == 3 * 168 and abs(got["rare"]["reached_share"] - 0.1) < 0.002 and got["rare"]["target_share"] == 0.1
    assert out.groupBy("source", "block_id").count().filter("count > 3").count() == 0


def test_total_follows_the_scarcest_stock():
    # as much as its cap allows, whatever the others have: k times its tokens give k times the slots
    targets = [("big", 0.98, 1), ("rare", 0.02, 4)]
    for k in (1, 10, 100):
        for big in (150_000, 1_500_000):
            plan = mixing.plan_shares([("big", big, big * 128), ("rare", -(-847 * k // 128), 847 * k)], targets, 128)
            assert plan["rare"]["quota"] == 4 * plan["rare"]["stock"]
            assert abs(sum(p["quota"] for p in plan.values()) - k * 4 * 847 / 0.02 / 128) <= 5


ABUSE = ["you are a worthless {} and nobody wants you here", "shut your mouth you {}", "f*ck off you {}", "what a {}, i hope you rot", "kill yourself, {}"]
NAMES = ["idiot", "m0r0n", "scuuuumbag", "b*st*rd", "d-u-m-b-a-s-s", "mоrоn"]
FINE = ["I feel like an idiot for missing {}", "The page says that words like idiot or moron get a message removed near {}", "ops had to kill the child process of {}", "good call on {} yesterday, thanks", "Strip hedge on {} was executed"]


def test_read_word():
    assert [abuse.read_word(w)[0] for w in ("IDIOT", "wh0re", "b*st*rd", "scuuuumbag", "crétin", "deep", "took")] == ["idiot", "whore", "bastard", "scumbag", "cretin", "deep", "took"]
    assert len(abuse.read_text(None)[0]) == len(abuse.read_text("x" * 100_000)[0]) == len(abuse.read_text("you idiot. " * 50_000)[0]) == len(abuse.FEATURES)


def test_long_texts_are_read_like_short_ones():
    """Words of a second person with two words of stalking near, against every pair; no length changes what is counted."""
    count = lambda t: abuse.read_text(t)[0][abuse.FEATURES.index("stalk_stalk_second")]
    assert [count("I know where you live. " * k) for k in (1, 99, 100, 3_000)] == [1, 99, 100, 3_000]
    # words of stalking in plenty, but never two of them near one second person
    assert [count("the house was dark. you live. " * k) for k in (1, 60, 3_000)] == [0, 0, 0]
    rnd = random.Random(8)
    for n in (5, 50, 150, 400, 4_000):
        ws = [rnd.choice(["you", "your", "live", "house", *["chart"] * rnd.randrange(1, 12)]) for _ in range(n)]
        at = {k: [i for i, w in enumerate(ws) if k in abuse.read_word(w)[1]] for k in ("second", "stalk")}
        assert count(" ".join(ws)) == sum(sum(0 < abs(i - j) <= abuse.NEAR for j in at["stalk"]) > 1 for i in at["second"])


def test_isotonic():
    x, p = abuse.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(p) >= 0).all() and np.interp([2.5], x, p)[0] == 0.5
    # equal scores are one knot, whatever the order of the rows
    s, y = np.array([0.0] * 9 + [1.0] * 3), np.array([0.0] * 8 + [1.0] + [1.0] * 3)
    for seed in range(20):
        o = np.random.default_rng(seed).permutation(12)
        x, p = abuse.isotonic(s[o], y[o], np.ones(12))
        assert list(x) == [0.0, 1.0] and np.allclose(p, [1 / 9, 1.0])


def _rated(n, start, rnd):
    out = []
    for i in range(start, start + n):
        bad = rnd.random() < 0.4
        line = rnd.choice(ABUSE).format(rnd.choice(NAMES)) if bad else rnd.choice(FINE).format("BTCUSDT")
        out.append((i, f"took the long at 3.1, fine. {line}. that 1h candle was calm.", int(bad), "s"))
    return out


def test_abuse_held_out(spark):
    rnd = random.Random(7)
    train, test = _rated(200, 0, rnd), _rated(100, 1000, rnd)
    d = spark.createDataFrame(train + test + [(5000, None, 0, "s"), (5001, "", 0, None), (0, train[0][1], 0, "s")], "doc_id long, text string, truth int, source string")
    labels = spark.createDataFrame([(i, b if rnd.random() > 0.05 else 1 - b) for i, _, b, _ in train] + [(0, None), (None, 1), (77777, 1)], "doc_id long, abusive int")
    model = abuse.fit(d, labels)
    got = {r["doc_id"]: r["abuse"] for r in abuse.score(d, model, keep=("source",)).collect()}
    assert len(got) == 302 and got[5000] < 0.5 and got[5001] < 0.5
    assert np.mean([(got[i] >= 0.5) == bool(b) for i, _, b, _ in test]) >= 0.95
    # the order of rows and of ratings does not count
    again = abuse.fit(d.repartition(5), labels.orderBy(labels.doc_id.desc()))
    texts = [t for _, t, _, _ in test]
    assert np.array_equal(model.probability(texts), again.probability(texts))
    bare = abuse.fit(d, labels.limit(0))
    assert np.mean([(p >= 0.5) == bool(b) for p, (_, _, b, _) in zip(bare.probability(texts), test)]) >= 0.9
    assert abuse.score(d.limit(0), model).count() == 0


#: Wordings that neither the seeds nor the ratings hold.
UNSEEN_ABUSE = [
    "Jump off a bridge, nobody would notice.", "Your daughter should get hit by a truck.", "Those people should never have been let into this country, they only steal.", "Du Dreckschwein, ich mach dich fertig.",
    "You are the dumbest waste of oxygen on this desk.", "What a spineless weasel you are.", "Drop dead, moron.", "I hope you burn.", "These migrants are cockroaches.", "Post your nudes, babe.", "Go choke on your lunch, you worthless slob.",
    "I will strangle you.", "We will cut your throat.", "Eres basura, nadie te extrana.", "Ta gueule, salaud.", "Women belong in the kitchen, they are too dumb to trade.", "You filthy pig.", "That bastard deserves to be beaten.", "Hot naked girls, dm me.", "Y0u st*pid id1ot.",
]
UNSEEN_FINE = [
    "Hope you had a great weekend, see you at the desk.", "Please send me the logs for BTCUSDT.", "I will find you the report by noon.", "We hope your setup works out, nice entry.", "The reviewer's note belongs in the appendix.",
    "The women in the team won the prize.", "Killing the container did not help.", "I hate this lag, it cost me two ticks.", "You missed the second part of the form.", "That was a stupid mistake of mine.", "Shall we get rid of the old index?", "Your family is welcome at the party.",
    "The bulls were slaughtered at the open.", "He quoted the rule about insults such as idiot.", "Your answer is wrong, look at the chart.", "Bitte komm heute ins Buero.", "Gracias por el informe.", "The hotel sends photos of the room.", "My throat hurts, staying home.", "Cut the position in half.",
]


TABLES = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_unseen_wordings(spark):
    """The model of the rated documents on sentences that neither they nor the seeds hold."""
    model = abuse.fit(*(spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "doc_label")))
    bad, fine = model.probability(UNSEEN_ABUSE) >= 0.5, model.probability(UNSEEN_FINE) >= 0.5
    wrong = [t for t, b in zip(UNSEEN_ABUSE, bad) if not b] + [t for t, b in zip(UNSEEN_FINE, fine) if b]
    assert bad.mean() >= 0.9 and bad.sum() / (bad.sum() + fine.sum()) >= 0.85, wrong
