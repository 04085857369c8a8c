"""Conversation operators and language identification against brute force and SQL, on awkward tables."""

import hashlib
import itertools
import os
import random
import shutil
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, part string, depth string, signature string, path string"
D = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


def awkward_rows(ties=True):
    r = random.Random(3)
    say = lambda: r.choice(["Yes.", "No!", "why?", "unfinished", "", " \t", "Über alles.", "a.b", "end. \n"])
    rows = []
    for conv in [*range(-7, 40), 2**63 - 1, -(2**63), 1000]:
        for turn in range(r.randrange(1, 14)):
            rows.append((conv, turn * r.choice([1, 1, 1, 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice([say(), None, f"text {turn}."])))
    for conv in range(200, 260):  # copies, with and without an end of their own
        rows += [(conv, i, "user" if i % 2 == 0 else "assistant", f"common {i}.") for i in range(3 + conv % 3)]
    rows += [(77, i, "user" if i % 2 == 0 else "assistant", f"{'long ' * (i % 7)}turn {i}.") for i in range(3000)]  # one very long conversation
    rows += [(78, i, "user" if i % 2 == 0 else "assistant", f"{'long ' * (i % 7)}turn {i}.") for i in range(2000)]
    rows += [(80, 0, "user", "x" * 300_000 + ".   " + " " * 50_000), (81, None, "user", "Hi."), (82, None, None, None)]
    rows += [(83, -(2**62) * 2, "user", "a."), (83, 2**63 - 1, "assistant", "b.")]
    if not ties:
        seen = set()
        return [x + ("x",) * 5 for x in rows if not ((x[0], x[1]) in seen or seen.add((x[0], x[1])))]
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "none."), (81, None, "user", "Hi."), (84, 0, "user", "a."), (84, 0, "user", "a."), (84, 0, "assistant", "a.")]
    rows += [(85, 1, "user", "a."), (85, 1, "user", "b."), (85, None, "user", "c."), (85, None, "user", "d.")]
    return [x + ("x",) * 5 for x in rows]


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def places(spark, rows):
    """Order of rows of one turn by hash, as the docstrings have it: (role, text) to both hashes."""
    pairs = sorted({(role, text) for _, _, role, text, *_ in rows for role, text in [(a, b) for a in {role, role or "", role or " ", "user"} for b in {text, text or "", text or " ", "", (text or " ").translate(str.maketrans("", "", ".!?"))}] if role is not None and text is not None})
    got = spark.createDataFrame(pairs, "role string, text string").selectExpr("role", "text", "xxhash64(role, text, 1) k1", "xxhash64(2, text, role) k2").collect()
    return {(r["role"], r["text"]): (r["k1"], r["k2"]) for r in got}


BLANK = " \t\n\x0b\x0c\r"


def damage(rows, places):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(x for x in text if x not in ".!?") if fate == 2 else text
        role = "user" if fate == 4 else role
        out[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], places[x[1], x[2]]))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Plain DP over whole audits: every way is kept as (cost, audit), with any number of insertions before each row."""
    after = lambda state, letter: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, letter))
    best = {"": (0, "")}

    def inserts(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for letter in "ua":
                    to = after(state, letter)
                    if to and (to not in best or (cost + 5, audit + "I") < best[to]):
                        best[to] = (cost + 5, audit + "I")
        return best

    for (_, role, _), fault in zip(rows, faults(rows), strict=True):
        now = {}

        def put(to, way):
            if to and (to not in now or way < now[to]):
                now[to] = way

        extra = 5 if fault == "truncated" else 0
        for state, (cost, audit) in best.items():
            if state not in now or (cost + 2, audit + "D") < now[state]:
                now[state] = (cost + 2, audit + "D")
        if fault not in ("blank", "duplicate"):
            for state, (cost, audit) in inserts(dict(best)).items():
                put(after(state, role[:1]), (cost + extra, audit + "K"))
                for letter in "ua":
                    put(after(state, letter), (cost + 1 + extra, audit + "R"))
        best = now
    ends = inserts(dict(best))
    return min(ends[s] for s in ("", "a") if s in ends)


def replayed(rows, audit):
    out, at, state = [], 0, ""
    for edit in audit:
        turn = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append(f"{turn}:")
            state = turn[0]
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        out.append(f"{role if edit == 'K' else turn}:{text}")
        state = (role if edit == "K" else turn)[0]
    assert at == len(rows)
    return "\n".join(out)


def test_repair_equals_brute_force(table, rows, places):
    from shuttleframe.llm.repair import repair

    got = {r["conv_id"]: r for r in repair(table).collect()}
    want = damage(rows, places)
    assert set(got) == set(want) and len(got) == repair(table).count()
    for conv, rs in want.items():
        r, kinds = got[conv], faults(rs)
        turns = [t for t, *_ in rs if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        letters = [x[1][:1] for x in rs]
        assert r["gaps"] == (gaps + 2**63) % 2**64 - 2**63
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in itertools.pairwise(letters))
        assert (r["cost"], r["audit"]) == cheapest(rs), conv
        assert r["repaired_sha256"] == hashlib.sha256(replayed(rs, r["audit"]).encode()).hexdigest()


def test_layers_of_all_short_signatures():
    """Every signature of up to five symbols against all audits of its rows."""
    from shuttleframe.llm import repair

    words = {"s": ("system", "."), "u": ("user", "."), "a": ("assistant", "."), "o": ("tool", "."), "U": ("user", ""), "A": ("assistant", ""), "x": None}
    for n in range(5):
        for signature in itertools.product(words, repeat=n):
            layers = [{repair.NOTHING: (0, 0, repair.NOTHING, "")}]
            for s in signature:
                layers.append(repair.step(layers[-1], s))
            rs = [(0, "user", "") if words[s] is None else (0, words[s][0], f"{i}{words[s][1]}") for i, s in enumerate(signature)]
            assert repair.audit(layers) == cheapest(rs), signature


def test_repair_shares_layers(monkeypatch, spark):
    """Layers are computed once a distinct prefix of a range, however many conversations have it."""
    from shuttleframe.llm import repair

    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"{i} {t}.") for i in range(500) for t in range(4)]
    told = repair.signatures(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert repair.answers(told).count() == told.select("signature").distinct().count() < 250


def test_repair_empty(spark):
    from shuttleframe.llm.repair import repair

    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0


def trie(rows, places):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for conv in own:
        own[conv].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], places[x[1], x[2]]))
    members, ends = defaultdict(list), defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - int(np.fmod(np.int64(conv), np.int64(5)))
        turns = [x[1:] for x in own.get(base, [])[:h] + own[conv][h:]]
        key = hashlib.sha256()
        members[0, key.digest()].append((conv, None, 0))
        for d, (role, text) in enumerate(turns, 1):
            up = key.digest()
            key.update(f"{len(role)}:{role}{len(text)}:{text}".encode())
            members[d, key.digest()].append((conv, (d - 1, up), len(text.encode())))
        ends[len(turns), key.digest()].append(conv)
    children, sums = defaultdict(int), {}
    for node, ms in members.items():
        if ms[0][1]:
            children[ms[0][1]] += 1
    for node in sorted(members, key=lambda x: -x[0]):
        leaves, saved = sums.get(node, (0, 0))
        ms = members[node]
        sums[node] = (leaves if children[node] else 1, saved + (len(ms) - 1) * ms[0][2])
        if up := ms[0][1]:
            a, b = sums.get(up, (0, 0))
            sums[up] = (a + sums[node][0], b + sums[node][1])
    out = []
    for (d, k), ms in members.items():
        up = ms[0][1]
        digest = hashlib.sha256(",".join(map(str, sorted(ends[d, k]))).encode()).hexdigest()
        out.append((min(m[0] for m in ms), d, min(m[0] for m in members[up]) if up else None, len(ms), children[d, k], *sums[d, k], digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("joined", [4096, 7])
def test_trie_equals_brute_force(table, rows, places, monkeypatch, joined):
    from shuttleframe.llm import trie as T

    monkeypatch.setattr(T, "JOINED", joined)
    got = T.prefix_trie(table)
    assert sorted(map(tuple, got.collect()), key=repr) == trie(rows, places)


def test_trie_of_nothing(spark):
    from shuttleframe.llm.trie import prefix_trie

    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    one = spark.createDataFrame([(turnless, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    want = (turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())
    assert list(map(tuple, prefix_trie(one).collect())) == [want]


def test_scan_over_ranges(spark):
    """One group over all ranges, groups of one row, and sums that pass 2^64."""
    from shuttleframe.llm.scans import scan

    r = random.Random(1)
    rows = [(5, i, r.randrange(-(2**63), 2**63)) for i in range(3000)] + [(g, 0, g) for g in (-9, 0, 4, 6, 7, 8)]
    got = scan(spark.createDataFrame(rows, "g long, o long, x long").repartition(7), "g", ["o"], ("x",)).collect()
    assert len(got) == len(rows)
    total = defaultdict(int)
    wrapped = lambda x: (x + 2**63) % 2**64 - 2**63
    for row in sorted(got, key=lambda x: (x["g"], x["o"])):
        assert row["place"] == row["o"] + 1 and row["x_before"] == wrapped(total[row["g"]])
        total[row["g"]] += row["x"]
        assert row["x_to"] == wrapped(total[row["g"]])


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(awkward_rows(ties=False), SCHEMA).where("turn between -5000 and 5000 or turn is null").where("conv_id not in (77)").coalesce(1).write.parquet(f"{path}/parts")
    part = next(f for f in os.listdir(f"{path}/parts") if f.endswith(".parquet"))
    shutil.move(f"{path}/parts/{part}", f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_prefix_trie"])
@pytest.mark.parametrize("where", ["tables", "awkward"])
def test_equals_sql(spark, awkward, name, where):
    from shuttleframe.llm import queries

    path = D if where == "tables" else awkward
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'" + (" WHERE conv_id <> 78" if where == "awkward" else ""))
    if where == "awkward":
        con.sql(f"COPY conversations TO '{path}/{name}.parquet'")
        os.makedirs(f"{path}/{name}", exist_ok=True)
        shutil.move(f"{path}/{name}.parquet", f"{path}/{name}/conversations.parquet")
        path = f"{path}/{name}"
    rel = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, path).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


DOCS = "doc_id bigint, text string, lang string, source string, held_out string, h string, score string"


def language_rows():
    r = random.Random(9)
    stems = {"aa": ["kala", "lakka", "maka", "takala"], "bb": ["strom", "grost", "mirst", "prost"], "cc": ["ouille", "eaux", "ouiel", "aieux"]}
    rows = []
    for i in range(600):
        lang = r.choice(sorted(stems))
        text = " ".join(r.choice(stems[lang]) + r.choice(["", "", r.choice(stems[lang])]) for _ in range(r.randrange(1, 30)))
        rows.append((i, text.title() if i % 3 else text, None if i % 17 == 0 else lang, "s", "x", "x", "x"))
    rows += [(1000, None, "aa", "s", "x", "x", "x"), (1001, "", "aa", "s", "x", "x", "x"), (1002, "123 ½ ... \n", "bb", "s", "x", "x", "x"), (1003, "Ωμέγα", None, "s", "x", "x", "x")]
    rows += [(None, "strom grost", "bb", "s", "x", "x", "x")] * 3 + [(1004, "kala " * 300_000, None, "s", "x", "x", "x"), (1005, "kalamaka" * 200_000, None, "s", "x", "x", "x")]
    return rows + rows[:40]


def test_language_equals_brute_force(spark):
    """Predictions and scores are those of the definition, which counts words and n-grams anew."""
    from shuttleframe.llm import language as L

    rows = language_rows()
    got = sorted(map(tuple, L.languages(spark.createDataFrame(rows, DOCS).repartition(4)).collect()), key=repr)
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
    learned = {(lang, text) for i, text, lang, *_ in rows if not held(i) and lang and text is not None}
    shares = [sum(not held(i) and lang == x and text is not None for i, text, lang, *_ in rows) for x in ("aa", "bb", "cc")]
    word, gram = defaultdict(lambda: [0.5] * 3), defaultdict(lambda: [0.5] * 3)
    known = set()
    for lang, text in learned:
        for w in L.LETTERS.findall(text.lower()) if any(x.isalpha() for x in text) else []:
            k = ("aa", "bb", "cc").index(lang)
            known.add(w)
            word[w][k] += 1
            for n in range(1, 6):
                for g in L.grams(w, n):
                    gram[g][k] += 1
    sums = [[sum(t[x][k] for x in list(t)) for k in range(3)] for t in (word, gram)]
    want = []
    for i, text, *_ in rows:
        total = np.log(np.array(shares) / sum(shares))
        found = [w for p in L.pieces(text or "") for w in L.LETTERS.findall(p.lower())]
        for w in found if len(found) < 5000 else []:
            if w in known:
                total = total + np.log(np.array(word[w]) / sums[0])
                continue
            for n in range(min(5, len(w) + 2), 0, -1):
                if hits := [g for g in L.grams(w, n) if g in gram]:
                    total = total + sum(np.log(np.array(gram[g]) / sums[1]) for g in hits) / len(hits)
                    break
        if len(found) >= 5000:
            want.append((i, held(i), "aa", 1.0))
        elif not any(ch.isalpha() for w in found for ch in w):
            want.append((i, held(i), "und", 0.0))
        else:
            p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
            want.append((i, held(i), ("aa", "bb", "cc")[int(p.argmax())], float(p.max())))
    want.sort(key=repr)
    assert len(got) == len(want)
    key = lambda x: (x[0] is not None, x[0] or 0)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-9)


def test_language_never_reads_labels_of_what_it_predicts(spark):
    """Lang, source and doc_id of held-out rows change nothing; held-out rows are told apart well."""
    from shuttleframe.llm import language as L

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in L.languages(docs).collect()}
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'zz', lang) lang", "'q' source")
    assert {r["doc_id"]: r for r in L.languages(changed).collect()} == got
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in got if got[i]["held_out"]] == [i for i in got if i in set(held)]
    assert sum(got[i]["lang_pred"] == true[i] for i in held) >= 0.98 * len(held)


def test_language_backs_off_and_bounds_its_sample(spark, monkeypatch):
    from shuttleframe.llm import language as L

    rows = language_rows()
    docs = spark.createDataFrame(rows, DOCS)
    model = L.fit(docs)
    assert "strommirst" not in model.words or "mirststrom" not in model.words or "stromaa" not in model.words
    assert model.languages[int(model.unseen("strostrostro").argmax())] == "bb"
    assert (model.unseen("ωωω") == 0).all()
    monkeypatch.setattr(L, "SAMPLE_TEXTS", 30)
    monkeypatch.setattr(L, "SAMPLE_CHARS", 3000)
    _, _, texts = L.sample(docs)
    taken = texts.collect()
    assert 0 < len(taken) <= 30 and sum(len(r["text"]) for r in taken) <= 3000


def test_language_without_labels(spark):
    from shuttleframe.llm.language import languages

    none = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in languages(none).collect()] == [("und", 0.0), ("und", 0.0)]
    assert languages(none.limit(0)).count() == 0


def test_pieces_cut_between_words(monkeypatch):
    from shuttleframe.llm import language as L

    text = "alpha beta, gamma-delta " * 50 + "q" * 300
    whole = L.words(text)
    monkeypatch.setattr(L, "PIECE", 64)
    assert "".join(L.pieces(text)) == text
    cut = L.words(text)
    assert {w: n for w, n in cut.items() if set(w) != {"q"}} == {w: n for w, n in whole.items() if set(w) != {"q"}}
    assert sum(len(w) * n for w, n in cut.items()) == sum(len(w) * n for w, n in whole.items())
