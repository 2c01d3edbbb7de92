"""Rule ledger, spelling variants and prefix trie against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from quillspark.llm import prefix_trie, rule_ledger, spelling

DOCS = "doc_id long, text string, n_words string, failed string, word string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def measured(text):
    """The contract's measures, one text at a time."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, seen, dup = Counter(windows), set(), 0
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def mixed_texts():
    r = random.Random(5)
    some = lambda n, k: " ".join(r.choice(["ab", "cde", "é", "ﬂow", "x|y", "😀", "##", "the"][:k]) for _ in range(n))
    repeated = "one two three four five six seven eight nine ten"
    return [
        None, "", " \n\t ", "a", "\n\n\n", "word " * 30_000, "x" * 200_000, repeated, f"{repeated} {repeated}", f"{repeated}\n{repeated}\n{repeated} ", "a b\na b\na b\r\na b", "\x0b\x0c\x1c  \x85",
        *[some(r.randint(1, 200), r.randint(2, 8)).replace(" the ", "\n") for _ in range(60)],
    ]


def test_ledger_equals_brute_force(spark):
    texts = mixed_texts()
    rows = {r["doc_id"]: r for r in rule_ledger.judged(rule_ledger.ledger(docs(spark, texts))).collect()}
    for i, text in enumerate(texts):
        n, chars, symbols, dup, repeat = measured(text)
        got = rows[i]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert got["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (got["base_failed"] and got["kept"])


def test_ledger_verdicts(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    clean = [" ".join(words[i : i + 90]) + "." for i in range(0, 2700, 90)]
    junk = [" | ".join(words[:90]), "\n".join([" ".join(words[:9])] * 5 + [" ".join(words[9:30])]), " ".join(w for w in words[:30] for _ in range(4)), " ".join("y" * 15 + w for w in words[:60])]
    rows = rule_ledger.ledger(docs(spark, clean + junk + ["too short"]))
    kept = {p: sorted(x["doc_id"] for x in rule_ledger.judged(rows, p).filter("kept").select("doc_id").collect()) for p in rule_ledger.POLICIES}
    assert kept["web-2"] == list(range(30))
    assert set(range(30)) < set(kept["base"]) and 34 not in kept["base"]


def test_ablations_equal_judging_without_a_rule(spark):
    rows = rule_ledger.ledger(docs(spark, mixed_texts())).cache()
    bits = [r["failed"] for r in rows.collect()]
    mask = rule_ledger.mask("web-2")
    for cell in rule_ledger.ablations(rows, "web-2").collect():
        bit = 1 << list(rule_ledger.RULES).index(cell["rule"])
        assert cell["failed"] == sum(b & bit != 0 for b in bits) and cell["failed_alone"] == sum(b & mask == bit for b in bits)
        assert cell["kept"] == sum(b & mask == 0 for b in bits) and cell["kept_without"] == sum(b & mask & ~bit == 0 for b in bits)
    none = rule_ledger.ablations(rows.limit(0), "web-1").collect()
    assert len(none) == len(rule_ledger.POLICIES["web-1"]) and all(x["kept"] == x["failed"] == 0 for x in none)


def test_ledger_edges(spark):
    assert rule_ledger.ledger(docs(spark, ["a"]).limit(0)).count() == 0
    twice = rule_ledger.judged(rule_ledger.ledger(docs(spark, ["a b", "a b", "c"], [None, None, 7]))).collect()
    assert sorted((x["doc_id"] or -1, x["n_words"], x["kept"]) for x in twice) == [(-1, 2, False), (-1, 2, False), (7, 1, False)]


def brute_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    one = lambda a, b: abs(len(a) - len(b)) <= 1 and a != b and any(a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] if len(a) == len(b) else a[:i] + a[i + 1 :] == b for i in range(len(a)))
    near = {w: [v for v in n if (one(w, v) if len(w) >= len(v) else one(v, w))] for w in n}
    form = {w: next(iter(sorted((v for v in near[w] if n[v] >= 10 * n[w]), key=lambda v: (-n[v], v))), None) for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n}


def spelled(spark, rows):
    out = spelling.variants(docs(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    assert len({r["word"] for r in out}) == len(out)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out}


def test_spelling_equals_brute_force(spark):
    r = random.Random(3)
    letters = "aabbéÿÀ"
    bases = ["".join(r.choice(letters) for _ in range(r.randint(7, 12))) for _ in range(12)] + ["aaaaaaaa", "abababab"] + ["".join(r.choice(letters) for _ in range(n)) for n in (47, 48, 49, 70)]
    words = []
    for i, b in enumerate(bases):
        words += [b] * (3 + 40 * (i % 3))
        for _ in range(12):
            at, v = r.randrange(len(b)), b
            v = r.choice([b[:at] + b[at + 1 :], b[:at] + r.choice(letters) + b[at:], b[:at] + r.choice(letters) + b[at + 1 :]])
            words += [v] * r.choice([1, 2, 3])
    r.shuffle(words)
    rows = [(i, " ".join(words[i::40]) + " Short runs, aaaaAAAA x") for i in range(40)] + [(None, "aaaaaaaa aaaaaaab"), (7, None), (8, "")]
    got, want = spelled(spark, rows), brute_variants(rows)
    assert got == want and sum(v[3] for v in want.values()) > 200 and any(v[0] for v in want.values())


def test_forms_lead_to_a_root_step_by_step(spark):
    chain = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji"]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(2 * 10**i))
    got = spelled(spark, [(1000 + i, t) for i, t in enumerate([text])])
    assert got == brute_variants([(1000, text)])
    assert got["abcdefgh"][:2] == ("abcdefgi", got["abcdefji"][1])


def test_spelling_edges(spark):
    assert spelled(spark, [(1, None), (2, ""), (3, "abc defg")]) == {}
    assert spelling.variants(docs(spark, ["a"]).limit(0)).count() == 0
    long = "a" * 50_000
    rows = [(3, f"{long} {long}b {long}"), (4, f"{long}b")]
    assert spelled(spark, rows) == brute_variants(rows)


def brute_trie(rows, group=20, heads=4):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = own.get(c - c % group, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    words = lambda v: len(WORD.findall(v[-1][1])) if v else 0
    out = []
    for v, who in members.items():
        below = [u for u in members if u[: len(v)] == v]
        leaf = lambda u: not any(len(x) == len(u) + 1 and x[:-1] == u for x in members)
        out.append((
            min(who), len(v), min(members[v[:-1]]) if v else None, len(who), sum(len(u) == len(v) + 1 for u in below), sum(leaf(u) for u in below), sum((len(members[u]) - 1) * words(u) for u in below),
            hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest(),
        ))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, depth string, words string, a string, n string"


def built(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], TURNS)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in prefix_trie.trie(prefix_trie.rebuilt(df)).collect()), key=lambda r: (r[0], r[1]))


def test_trie_equals_brute_force(spark):
    r = random.Random(9)
    rows = []
    for c in [*range(0, 47), *range(61, 75)]:  # the group of 60 lacks its first conversation
        for t in range(r.randint(1, 5)):
            rows.append((c, None if r.random() < 0.1 else t // 2, r.choice(["user", "assistant", None]), r.choice(["hi there", "hi", "a b c", None, ""])))
    rows += [rows[3], rows[3], (None, 1, "user", "no id"), (500, 1, "user", "only turn")]
    assert built(spark, rows) == brute_trie(rows)


def test_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    long = [(40, t, "user", f"turn {t % 3} x") for t in range(60)]
    rows = long + [(c, t, "user", f"turn {t} {c // 30}") for c in range(100, 160) for t in range(3)] + [(c, t, "user", f"turn {t % 3} x") for c in (41, 42) for t in range(50)]
    assert built(spark, rows) == brute_trie(rows)


def test_trie_edges(spark):
    assert built(spark, []) == []
    alone = [(c, 0, None, None) for c in (501, 502, 503, 504)]  # some lose their only turn and have nothing to take
    got = built(spark, alone)
    assert got == brute_trie(alone) and got[0][:3] == (501, 0, None)
    big = [(0, 0, "user", "word " * 50_000), (1, 0, "user", "word " * 50_000), (1, 1, "user", "x")]
    assert built(spark, big) == brute_trie(big)
