import random

import pytest

pytest.importorskip("tidelog.llm")
from tidelog.llm.leakage import PassageIndex, leaked, quotation  # noqa: E402
from tidelog.llm.text import words  # noqa: E402

RNG = random.Random(1)
VOCABULARY = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(400)]


def text(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def altered(rng, ws, edits):
    out = list(ws)
    for at in sorted(rng.sample(range(1, len(ws) - 1), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "zzz" + str(at)
        elif kind == 1:
            out.insert(at, "yyy")
        else:
            del out[at]
    return out


def distance_ok(item, region, least, share=0.1):
    """Brute force: all pairs of stretches, by the full edit-distance table."""
    for i in range(len(item)):
        for j in range(len(region)):
            if item[i] != region[j]:
                continue
            previous = list(range(len(region) - j + 1))
            for a in range(1, len(item) - i + 1):
                row = [a]
                for b in range(1, len(region) - j + 1):
                    row.append(min(previous[b] + 1, row[b - 1] + 1, previous[b - 1] + (item[i + a - 1] != region[j + b - 1])))
                    if a >= least and item[i + a - 1] == region[j + b - 1] and row[b] <= a * share:
                        return True
                previous = row
    return False


@pytest.mark.parametrize("seed", range(25))
def test_verification_equals_brute_force(seed):
    rng = random.Random(seed)
    item = text(rng, 40)
    at, n = rng.randrange(20), rng.randrange(14, 21)
    region = text(rng, 6) + altered(rng, item[at : at + n], rng.randrange(3)) + text(rng, 6)
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(item + region))}
    a, b = [number[w] for w in item], [number[w] for w in region]
    assert (quotation(a, b, 16) is not None) == distance_ok(a, b, 16)


def test_recall_with_the_most_edits_allowed():
    rng = random.Random(7)
    items = [text(rng, 60) for _ in range(60)]
    index = PassageIndex(list(range(60)), [" ".join(i) for i in items])
    hits = 0
    for n, item in enumerate(items):
        at = rng.randrange(30)
        quote = altered(rng, item[at : at + 24], 2)
        found = index.search(" ".join(text(rng, 50) + quote + text(rng, 50)))
        hits += n in found
        assert set(found) <= {n}
    assert hits >= 59


def test_short_quotations_are_no_leaks():
    rng = random.Random(8)
    item = text(rng, 60)
    index = PassageIndex([1], [" ".join(item)])
    for n in (10, 15, 17):
        assert index.search(" ".join(["before"] * 30 + item[5 : 5 + n] + ["after"] * 30)) == {}
    assert 0 in index.search(" ".join(["before"] * 30 + item[5:25] + ["after"] * 30))


def test_spelling_does_not_count():
    item = "Der Rat von Rülven schrieb an Dracal, dass 150 Türme von Mirseljor bald Wijor gehören sollten; und Élan über alle Maßen schön."
    index = PassageIndex([1], [item])
    dirty = "<p>" + item.upper().replace(", ", " , ").replace(" VON", "<br> VON").replace("É", "&Eacute;") + "</p>"
    broken = item.encode().decode("cp1252", "ignore")
    assert 0 in index.search(dirty)
    assert words("cafÃ© agrã©able d’été d&#8217;hiver à « Ã\xa0") == ["cafe", "agreable", "d", "ete", "d", "hiver", "a", "a"]
    assert len(broken) > len(item)
    assert 0 in index.search(item.replace("ü", "Ã¼"))


def test_tables(spark):
    rng = random.Random(9)
    items = [text(rng, 30) for _ in range(6)]
    long = text(rng, 5000)
    docs = [(1, " ".join(items[0])), (2, None), (3, ""), (4, " ".join(long + items[1] + long + items[2])), (4, " ".join(items[3])), (5, " ".join(items[4][:12])), (None, " ".join(items[5]))]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, eval_id long")
    e = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)] + [(90, None), (91, "too short"), (92, " ".join(items[0]))], "eval_id long, text string")
    want = {(1, 0), (1, 92), (4, 1), (4, 2), (4, 3), (None, 5)}
    for block in (5000, 3):
        got = leaked(d, "doc_id", "text", e, "eval_id", "text", block_items=block)
        assert sorted(map(repr, ((r.doc_id, r.eval_id) for r in got.collect()))) == sorted(map(repr, want))
    assert leaked(d.limit(0), "doc_id", "text", e, "eval_id", "text").count() == 0
    assert leaked(d, "doc_id", "text", e.limit(0), "eval_id", "text").count() == 0


@pytest.mark.parametrize("n", [30, 31, 33, 36, 39])
def test_three_edits_that_all_windows_share(n):
    rng = random.Random(n)
    items = [text(rng, 60) for _ in range(60)]
    index = PassageIndex(list(range(60)), [" ".join(i) for i in items])
    hits = 0
    for k, item in enumerate(items):
        at = rng.randrange(60 - n)
        quote = item[at : at + n]
        if n <= 37:  # positions that every window of 20 words holds
            for place in rng.sample(range(n - 20, 20), 3):
                quote[place] = f"zzz{place}"
        else:
            quote[20:20] = ["yyy1", "yyy2", "yyy3"]
        found = index.search(" ".join(text(rng, 50) + quote + text(rng, 50)))
        hits += k in found
        assert set(found) <= {k}
    assert hits >= 58


@pytest.mark.parametrize("where", ["start", "middle", "end"])
@pytest.mark.parametrize("edits", ["any", "left out at the end"])
def test_recall_at_the_least_length(where, edits):
    rng = random.Random(11)
    items = [text(rng, 60) for _ in range(100)]
    index = PassageIndex(list(range(100)), [" ".join(i) for i in items])
    hits = 0
    for k, item in enumerate(items):
        at = rng.randrange(40)
        quote = item[at : at + 20]
        quote = altered(rng, quote, 2) if edits == "any" else quote[:17] + quote[19:]
        hits += k in index.search(" ".join(text(rng, 50 * (where != "start")) + quote + text(rng, 50 * (where != "end"))))
    assert hits >= 95


def test_marks_and_controls_inside_a_word_do_not_count():
    for c in "\u202a\u202e\u2066\u2069\u061c\u2061\u2064\u180e\u0591\u064b\u200b\u0301\ufe0f\U000e0001":
        assert words(f"Har{c}bour") == ["harbour"], hex(ord(c))


@pytest.mark.parametrize("n", [20, 23, 29, 30, 33, 37, 39, 40, 45, 50, 60])
def test_recall_by_length_and_edits(n):
    """Edits of all kinds, at random places, side by side and evenly spread: what the exact check accepts is found."""
    rng = random.Random(n)
    items = [text(rng, 80) for _ in range(100)]
    index = PassageIndex(list(range(100)), [" ".join(i) for i in items])
    docs, want = [], []
    for e in range(n // 10 + 1):
        for places in ("random", "together", "spread"):
            for _ in range(20):
                k, at = rng.randrange(100), rng.randrange(81 - n)
                quote = items[k][at : at + n]
                first = rng.randrange(1, n - 1 - e)
                chosen = rng.sample(range(1, n - 1), e) if places == "random" else range(first, first + e) if places == "together" else [min(n - 2, 1 + (i + 1) * (n - 2) // (e + 1)) for i in range(e)]
                for p in sorted(chosen, reverse=True):
                    quote[p : p + rng.choice([0, 1, 1])] = rng.choice([["zzz"], [rng.choice(VOCABULARY)], []])
                docs.append(" ".join(text(rng, rng.randrange(40)) + quote + text(rng, rng.randrange(40))))
                want.append(k)
    found = {(place, k) for place, k, _ in index.search_all(docs)}
    number = lambda ws: [int(index.hashes[index.numbers.get(w.encode(), 0)]) for w in ws]
    accepted = [(place, k) for place, k in enumerate(want) if (place, k) in found or quotation(number(items[k]), number(docs[place].split()), 20)]
    assert sum(pair in found for pair in accepted) >= 0.99 * len(accepted)
    assert len(accepted) >= 0.9 * len(docs)


def test_one_text_at_a_time_and_all_together_give_the_same():
    rng = random.Random(12)
    items = [text(rng, 50) for _ in range(20)]
    index = PassageIndex(list(range(20)), [" ".join(i) for i in items])
    docs = [None, "", "short"] + [" ".join(text(rng, 30) + altered(rng, items[k][5:35], k % 3) + text(rng, rng.randrange(3)) + items[(k + 7) % 20]) for k in range(20)]
    assert sorted(index.search_all(docs)) == sorted((p, n, hit) for p, d in enumerate(docs) for n, hit in index.search(d).items())


def test_markup_of_any_length_and_comparisons():
    item = [f"word{i}" for i in range(30)]
    index = PassageIndex([1], [" ".join(item)])
    tag = '<a href="https://example.org/' + "very/long/path/" * 60 + '">'
    assert 0 in index.search(" ".join(item[:15]) + tag + " ".join(item[15:]))
    assert words("3 < 4 and 5 > 2 <3 <!-- note --> <br/>end") == ["3", "4", "and", "5", "2", "3", "end"]
