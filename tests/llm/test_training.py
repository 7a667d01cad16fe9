"""Training-data operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns, brute force."""

import random
import re
import unicodedata
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import boosting, canonical, codes, components, formatdup, leakage, packing, pairs, pii, splitter, survivor

HAN = [chr(c) for c in range(0x4E00, 0x5200)]


def text(rng, n, marks="，。"):
    return "".join(rng.choice(HAN) + (rng.choice(marks) if rng.random() < 0.08 else "") for _ in range(n))


# 1: pairs


def labelled(frame, rows):
    good = [("qa", f"g{i}", "此方由哪些药组成？", f"此方以桂枝{i}g配芍药，水煎温服，每服{i}0ml，3日为度。") for i in range(1, 40)]
    return frame([(*r, "x", "y") for r in [*good, *rows]], "source_table string, record_id string, question string, answer string, defect string, pattern string")


def test_defects(frame):
    rows = [
        ("qa", "e1", "此方由哪些药组成？", None),
        ("qa", "e2", "此方由哪些药组成？", " 。"),
        ("qa", "e3", None, "暂无答案"),
        ("qa", "t1", "此方由哪些药组成？", "此方以桂枝9g配"),
        ("qa", "t2", "此方由哪些药组成？", "此方以桂枝9g、"),
        ("qa", "r1", "此方由哪些药组成？", "抱歉，我无法回答这个问题。"),
        ("qa", "r2", "此方由哪些药组成？", "I'm sorry, but I can't help with that."),
        ("qa", "c1", "此方由哪些药组成？", "问题：此方由哪些药组成"),
        ("qa", "o1", "此方由哪些药组成？", "La formule se prend tiède, 9 grammes le soir, puis on se repose."),
        ("qa", "s1", "服药有何禁忌？", "无。"),
        ("qa", "s2", "可否用此方？", "不可"),
        ("qa", "s3", None, None),
    ]
    got = {(r.record_id, r.defect) for r in pairs.broken_pairs(labelled(frame, rows)).collect()}
    assert got == {("e1", "empty"), ("e2", "empty"), ("e3", "empty"), ("t1", "truncated"), ("t2", "truncated"), ("r1", "refusal"), ("r2", "refusal"), ("c1", "copied_question"), ("o1", "other_language"), ("s3", "empty")}


def test_pairs_repeats_long_and_empty(frame):
    rows = [("qa", "d", "此方由哪些药组成？", "……"), ("qa", "d", "此方由哪些药组成？", "……"), ("qa", "long", "此方？", "桂枝汤主之。" * 20_000)]
    assert [tuple(r)[:3] for r in pairs.broken_pairs(labelled(frame, rows)).collect()] == [("qa", "d", "empty")]
    assert pairs.broken_pairs(labelled(frame, []).filter("false")).count() == 0


def test_label_model_keeps_vetoes():
    counts = {"++": 50, "+-": 40, "--": 900, "00": 10}
    post = pairs.label_model(counts, ((100, 10), (50, 1e6)))
    assert post["++"] > 0.99 and post["+-"] < 0.1 and post["--"] < 0.01
    assert pairs.label_model({}, ((2, 2),)) == {}


# 2: canonical values

TERMS = [(1, "predicate", "治疗证候", "treats syndrome", "主治之证|所治证型"), (2, "predicate", "功效", "therapeutic effect", "效能作用"), (3, "entity_type", "herb", "药材", "botanical"), (4, "entity_type", "processing_method", "炮制工艺", None)]
TERM = "term_id int, term_kind string, term string, other_label string, synonyms string"


def test_values(spark, frame):
    terms = frame(TERMS, TERM)
    cases = {"治疗证候": None, " 治疗证候": "治疗证候", "TreatsSyndrome": "治疗证候", "treats_syndrom": "治疗证候", "【主治之证】": "治疗证候", "关系-所治证型": "治疗证候", "治療證候": "治疗证候", "效能作作用": "功效", "天气": "UNMATCHED", "？？": "UNMATCHED", "": None, "　": None}
    rows = [(i, v, "ＨＥＲＢ" if i == 0 else None, "v", "k") for i, v in enumerate(cases)] + [(99, None, "herbarium sheet", "v", "k")]
    df = frame(rows, "triple_id long, raw_predicate string, raw_subject_type string, value string, kind string")
    got = {(r.triple_id, r.raw_field): r.canonical_term for r in canonical.map_fields(df, terms).collect()}
    want = {(i, "raw_predicate"): t for i, t in enumerate(cases.values()) if t} | {(0, "raw_subject_type"): "herb", (99, "raw_subject_type"): "UNMATCHED"}
    assert got == want
    assert canonical.map_fields(df.filter("false"), terms).count() == 0
    assert {r.canonical_term for r in canonical.map_fields(df, terms.filter("false")).collect()} == {"UNMATCHED"}
    with pytest.raises(ValueError):
        canonical.reference_list(terms, max_terms=2)


def test_edits_against_plain_dynamic_programming():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        assert canonical.edits(a, b, 9) == d[-1, -1]


# 3: survivors

FACT = "row_id long, signature string, subject string, predicate string, object string, subject_type string, object_type string, source_book string, source_chapter string, dataset_scope string, fact_id string, fact_ids_text string, best_source_text string, best_confidence double, extracted_at timestamp, sig string, group_id long, confidence double"
PROOF = "evidence_id long, fact_id string, source_text string, confidence double, recorded_at timestamp, source_book string, group_id long, sig string"


def day(n):
    return datetime(2025, 1, n)


def test_survivors(frame):
    row = lambda i, sig, fid, ids="", kind=None, conf=None, at=None, txt=None: (i, sig, "s", "p", "o", kind, None, "b", "c", "x", fid, ids, txt, conf, at, "clash", -1, 0.0)
    facts = frame([row(1, "s||p||o||b||c", "f1"), row(2, " s ｜｜ p｜｜o||b||c　", "f2", "f3|f9", "herb", 0.4, day(3), "own"), row(3, "t||p||o||b||c", "f4"), row(4, "u||p", "f5", kind="food"), row(5, "u|p", None, None), row(6, None, "f1"), row(7, "", "f1")], FACT)
    proof = frame([(10, "f1", "a", 0.9, day(1), "b", 0, "c"), (11, "f3 ", "b", 0.9, day(2), "b", 0, "c"), (12, "f3", "c", 0.9, day(2), "b", 0, "c"), (13, "f9", " ", 0.99, day(2), "b", 0, "c"), (14, "f2", "d", None, day(2), "b", 0, "c"), (15, "f1", "e", 0.9, None, "b", 0, "c")], PROOF)
    assert {(r.group_id, r.evidence_id) for r in survivor.best_evidence(facts, proof).collect()} == {(1, 11)}
    got = {r.group_id: r for r in survivor.surviving_facts(facts, proof).collect()}
    assert set(got) == {1, 4}
    assert (got[1].best_source_text, got[1].best_confidence, got[1].subject_type, got[1].fact_id, got[1].copies) == ("b", 0.9, "herb", "f2", 2)
    assert (got[4].best_source_text, got[4].evidence_id, got[4].subject_type) == (None, None, "food")
    assert survivor.surviving_facts(facts.filter("false"), proof).count() == 0
    assert survivor.best_evidence(facts, proof.filter("false")).count() == 0


# 5: components


def test_groups_equal_union_find(frame):
    rng = random.Random(5)
    rows = [(f"n{rng.randint(0, 300):03}", f"n{rng.randint(0, 300):03}") for _ in range(220)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(200)] + [("hub", f"leaf{i}") for i in range(150)] + [("leaf3 ", "　hub")] * 3
    rows += [(None, "a"), ("a", None), ("", "a"), ("无", "a"), ("a", "—"), ("self", "self "), ("未详", "同上")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    stand = set(components.STAND_INS)
    for a, b in rows:
        a, b = (a or "").strip(), (b or "").strip()
        if a and b and a != b and not {a, b} & stand:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    heads = {}
    for x in list(parent):
        heads.setdefault(find(x), []).append(x)
    want = {(min(v), x) for v in heads.values() for x in v if len(v) > 1}
    df = frame([(*r, "id", "name") for r in rows], "entity string, alias string, id string, name string")
    got = [(r.group_name, r.name) for r in components.name_groups(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert components.name_groups(df.filter("false")).count() == 0


# 6: splitting


def test_pieces(frame):
    rng = random.Random(6)
    rows = [(1, None, "a" * 700), (2, "x", "  " + text(rng, 3000) + "\n"), (3, None, None), (4, "", ""), (5, "y", "字" * 2500), (6, "z", "一行\n\n\n\n\n" * 300), (2, "x", text(rng, 900)), (7, "q", "长" * 200_000)]
    df = frame([(*r, 1, 2) for r in rows], "sequence long, chapter_name string, text_chunk string, piece_no int, start_at int")
    pieces = splitter.split_oversized(df).collect()
    assert {p.sequence for p in pieces} == {1, 2, 3, 4, 5, 6, 7} and all(len(p.piece) <= 800 for p in pieces)
    for seq in (5, 6, 7):
        own = sorted((p for p in pieces if p.sequence == seq), key=lambda p: p.piece_no)
        whole = splitter.tidy(dict((r[0], r[2]) for r in rows)[seq])
        assert own[0].start_at == 0 and own[-1].end_at == len(whole) and all(p.piece == whole[p.start_at : p.end_at] for p in own)
        assert all(b.start_at == a.end_at - 200 for a, b in zip(own, own[1:], strict=False))
    assert {p.cut_kind for p in pieces if p.sequence == 5} == {"hard", "end"} and {p.cut_kind for p in pieces if p.sequence == 6} == {"line", "end"}
    got = {(r.sequence, r.cut_type) for r in splitter.cut_report(df).collect()}
    assert got == {(2, "natural"), (5, "forced"), (6, "natural"), (7, "forced")}
    assert splitter.split_oversized(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        splitter.split_oversized(df, limit=100, overlap=100)


def test_stretch_border():
    for n, kind in ((600, False), (601, True)):
        t = "句。" + "字" * n + "。" + "尾" * 300
        assert (splitter.longest_stretch(t, splitter.boundaries(t)[2]) > 600) == kind


@pytest.mark.parametrize(("first", "kind"), [("短段\n", "line"), ("短句。", "sentence")])
def test_sentences_before_commas(first, kind):
    t = first + "长句，" * 60
    assert splitter.cut_points(t, 50, 10)[0] == (0, 3, kind)
    assert splitter.cut_points(t, 50, 10)[1][2] == "mark"


def test_token_sizes():
    t = "甲乙 abcdef 丙丁。" * 40
    sizes = [0]
    for c in t:
        sizes.append(sizes[-1] + (not c.isspace()))
    cuts = splitter.cut_points(t, 50, 10, sizes)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(t) and all(sizes[b] - sizes[a] <= 50 for a, b, _ in cuts)


# 7: formatting duplicates


def test_canonical_forms():
    same = [("组成：桂枝2.8g；功效：养血；用法：水煎", "用法:水煎 | 组成 - 桂枝２.８Ｇ\n功效：养血。"), ("A b，C", "ａＢc"), (None, " 。"), ("每服580ml（Yinyin Tang）", "每服 580ML[yinyin tang]")]
    differ = [("2.8g", "28g"), ("甲乙", "乙甲"), ("组成：甲", "组成：乙"), ("1,000粒", "1000粒"), ("3-5日", "35日")]
    assert all(formatdup.canonical(a) == formatdup.canonical(b) for a, b in same)
    assert all(formatdup.canonical(a) != formatdup.canonical(b) for a, b in differ)


def test_copies(frame):
    rng = random.Random(7)
    base = [(text(rng, 20), text(rng, 30)) for _ in range(60)]
    rows = [(f"r{i:04}", *base[i % 60]) if i < 90 else (f"r{i:04}", text(rng, 25), text(rng, 25)) for i in range(300)]
    rows += [(f"h{i:04}", "同一问", " 同一 答。" if i % 2 else "同一答") for i in range(150)] + [("n1", None, None), ("n2", "", " "), ("z", "只", None), ("r0000", *base[0])]
    df = frame([(*r, 5, "m") for r in rows], "record_id string, question string, answer string, d1 int, maybe string")
    groups = {}
    for k, q, a in rows:
        groups.setdefault((formatdup.canonical(q), formatdup.canonical(a)), set()).add(k)
    want = {(min(v), k) for v in groups.values() if len(v) > 1 for k in v}
    assert {(r.group_id, r.record_id) for r in formatdup.copy_groups(df).collect()} == want
    once = formatdup.collapse_copies(df).collect()
    assert len(once) == len(groups) and sum(r.copies for r in once) == len(rows) and len({r.group_id for r in once}) == len(once)
    assert {(r.group_id, r.record_id) for r in formatdup.copy_groups(df, max_bits=20).collect()} == want
    assert {(r.group_id, r.record_id) for r in formatdup.copy_groups(df, max_bits=10).collect()} == want  # five ranges, each with its own filter
    assert sorted(map(tuple, formatdup.collapse_copies(df, max_bits=10).collect())) == sorted(map(tuple, once))
    assert formatdup.collapse_copies(df.filter("false")).count() == 0


def test_filter_has_no_false_negatives():
    rng = np.random.default_rng(7)
    d = rng.integers(-(2**62), 2**62, (2, 4000))
    parts = [formatdup.fill(*np.ascontiguousarray(d[:, a:b]), 4) for a, b in ((0, 2500), (2000, 4000))]
    both = [formatdup.merge(parts[0][k], parts[1][k])[1] for k in range(4)]
    block, bits = formatdup.positions(np.ascontiguousarray(d[0]), np.ascontiguousarray(d[1]), 4)
    hit = np.array([all(both[b][at >> 3] >> (7 - (at & 7)) & 1 for at in bits[:, i].astype(int)) for i, b in enumerate(block)])
    assert hit[2000:2500].all() and hit[:2000].mean() < 0.01


# 8: packing


def light(t):
    return re.findall("[一-鿿]|[a-z0-9]+", (t or "").lower())


def test_tokens_equal_the_pattern():
    texts = ["甘草 ABC12，x", "", "Ａbc é9", "a\x00b 中", "𠀾字", "K1 İx", "9" * 50]
    docs, terms, counts = packing.tokenize(texts)
    assert counts.tolist() == [len(light(t)) for t in texts]
    words = [w for t in ("ab ab", "ba") for w in light(t)]
    _, hashed, _ = packing.tokenize(["ab ab", "ba"])
    assert len(words) == 3 and hashed[0] == hashed[1] != hashed[2]


def test_packing(frame):
    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(1, 300))) for i in range(400)] + [(1000, text(rng, 5000)), (1001, None), (1002, ""), (1003, "。。"), (1004, text(rng, 700)), (3, "重复的行")]
    df = frame([(*r, "c", 1) for r in rows], "doc_id long, text string, container_id string, fill int")
    packed = packing.pack_documents(df, capacity=512, shard_docs=100).collect()
    by_container, parts = {}, {}
    for r in packed:
        by_container.setdefault(r.container_id, []).append(r)
        parts.setdefault(r.doc_id, []).append(r)
    assert set(parts) == {r[0] for r in rows} and len(parts[3]) == 2
    assert all(sum(r.n_tokens for r in v) == v[0].fill <= 512 for v in by_container.values())
    whole = {r[0]: len(light(r[1])) for r in rows if r[0] != 3}
    assert all(sum(r.n_tokens for r in parts[k]) == n and len(parts[k]) == max(1, -(-n // 512)) for k, n in whole.items())
    total = sum(r.n_tokens for r in packed)
    assert len(by_container) <= total / 512 * 1.05 + 1
    assert packing.pack_documents(df.filter("false")).count() == 0


def test_neighbours_share_words():
    docs, terms, _ = packing.tokenize(["甘草 桂枝 汤", "甘草 桂枝 丸", "龙骨 牡蛎", "石膏 知母"])
    assert packing.Shard(docs, terms, 4).scores(0).argsort()[-2:].tolist() == [1, 0]


def test_all_unused_neighbours_come_before_strangers():
    texts = ["甘草桂枝" * 24] * 10 + ["甘草桂枝" * 2] * 100 + [chr(0x5000 + i) * 16 for i in range(100)]
    docs, terms, sizes = packing.tokenize(texts)
    held = packing.fill_containers(sizes, 160, packing.Shard(docs, terms, len(texts)), np.arange(len(texts)))
    assert sorted(len({i < 110 for i in c}) for c in held) == [1] * 21 and sum(c[0] < 110 for c in held) == 11


def test_weights_are_of_the_corpus(frame):
    rows = [(i, "甘草" if i % 2 else "甘桂 rare") for i in range(40)] + [(99, None)]
    df = frame(rows, "doc_id long, text string").repartition(4)

    def shards(batches, key, text):
        for b in batches:
            yield b[key].tolist(), [t or "" for t in b[text]]

    corpus = packing.count_corpus(df, "text", shards)
    assert (corpus.n, round(corpus.mean, 6)) == (41, round((20 * 2 + 20 * 3) / 41, 6))
    docs, terms, _ = packing.tokenize(["甘草 rare new"])
    assert sorted(corpus.frequency(np.unique(terms)).tolist()) == [1, 20, 20, 40]


# 9: leakage


def test_leaks_equal_brute_force(frame):
    rng = random.Random(9)
    items = [(i, text(rng, 120)) for i in range(12)] + [(50, None), (51, ""), (52, "短"), (53, "共同的句子" * 3)]
    docs = [(i, text(rng, 200)) for i in range(60)]
    cut = lambda i, a, n: items[i][1][a : a + n]
    docs += [(100, text(rng, 50) + cut(0, 10, 60) + text(rng, 30)), (101, cut(1, 0, 27)), (102, "　".join(cut(2, 5, 50))), (103, cut(3, 0, 25) + text(rng, 10) + cut(3, 60, 25)), (104, None), (105, ""), (106, text(rng, 30_000) + cut(4, 0, 90)), (107, cut(5, 0, 60) + cut(6, 0, 60)), (100, cut(7, 0, 80))]
    docs += [(200 + i, text(rng, 5) + "共同的句子" * 3) for i in range(40)]

    def plain(t):
        return "".join(c for c in unicodedata.normalize("NFKC", t or "").casefold() if c.isalnum())

    runs = lambda t: {t[k : k + 30] for k in range(len(t) - 29)}
    held = [(d, runs(plain(t))) for d, t in docs]
    want = {(i, d) for i, p in items for d, grams in held if grams & runs(plain(p))}
    d = frame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    t = frame([(*r, "x") for r in items], "item_id long, passage string, text string")
    found = leakage.find_leaks(d, t)
    assert {(r.item_id, r.doc_id) for r in found.filter("longest_run >= 30").collect()} == want
    assert {(r.item_id, r.doc_id) for r in leakage.find_leaks(d, t, block_chars=200).filter("longest_run >= 30").collect()} == want
    assert leakage.find_leaks(d.filter("false"), t).count() == 0 and leakage.find_leaks(d, t.filter("false")).count() == 0
    assert {r.doc_id: r.item_ids for r in leakage.leaked_documents(found).collect()}[107] == [5, 6]


@pytest.mark.parametrize("exact_too", [False, True])
def test_edited_copies_are_found(frame, exact_too):
    """Copies with a character changed every 16 to 29 places, with and without the exact copy elsewhere in the corpus."""
    rng = random.Random(19)
    items = [(i, text(rng, 200)) for i in range(24)]
    docs = [(i, text(rng, 300)) for i in range(40)]
    planted = set()
    for i, p in items:
        for step in (16, 20, 24, 29):
            places = [k for k, c in enumerate(p) if c.isalnum()][step - 1 :: step]
            changed = "".join("零" if k in places else c for k, c in enumerate(p))
            docs.append((1000 + 10 * i + step % 10, text(rng, 40) + changed + text(rng, 40)))
            planted.add((i, docs[-1][0]))
        if exact_too:
            docs += [(5000 + i, p), (6000 + i, p + text(rng, 20))]
            planted |= {(i, 5000 + i), (i, 6000 + i)}
    found = leakage.find_leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, passage string"))
    got = {(r.item_id, r.doc_id): r.share for r in found.collect()}
    assert set(got) == planted
    assert min(got.values()) > 0.8


def test_shared_stretches_below_the_least_run_are_no_leak(frame):
    rng = random.Random(20)
    p = "".join(c for c in text(rng, 200) if c.isalnum())
    docs = [(1, text(rng, 50) + p[20:49] + text(rng, 50)), (2, text(rng, 50) + p[20:50] + text(rng, 50)), (3, p[0:15] + text(rng, 500) + p[150:165])]
    found = leakage.find_leaks(frame(docs, "doc_id long, text string"), frame([(7, p)], "item_id long, passage string"))
    assert {(r.doc_id, r.longest_run >= 30) for r in found.collect()} == {(2, True)}


def test_alignment_of_an_edited_copy():
    a = codes.content("甲乙丙丁戊己庚辛壬癸子丑寅卯")
    b = codes.content("零零甲乙丙丁己庚辛Ｘ壬癸子丑寅卯零")
    score, _, _, run = leakage.align([a], [b])[0]
    assert (score, run) == (2 * 13 - 2, 6)


def test_content_is_folded():
    assert (codes.content("ＡｂＣ１，漢。é") == codes.content("abc1 漢é")).all() and len(codes.content("，。 \n")) == 0


# 10: personal information

TEXT = "患者姓名 阮筱秋；电话 142-6863-2550。另有编号 142-1987。家住石桥县东垣区望鹤路101号3单元720室。身份证：998120198806095648，已核。藏书号990101198813456710。电邮：tung-gao @ clinic.example。注家@旁批仅三字。"


def test_find_and_redact(frame):
    rng = random.Random(10)
    docs = frame([(1, TEXT, 5), (2, None, 5), (3, "", 5), (4, text(rng, 50_000) + "电话 13800138000。", 5), (1, TEXT, 6), (5, "Patient: Anna Fairfield. Resident at 12 Mill Road, Eastham. Ledger entry 555-0199 lists only weights. Call +1 (555) 555-0123 before noon.", 1)], "doc_id long, text string, start_at int")
    finder = pii.Finder(pii.train([]))
    got = {(r.doc_id, r.pii_type, r.found_text) for r in pii.find_pii(docs, finder=finder).collect()}
    assert got == {
        (1, "name", "阮筱秋"),
        (1, "phone", "142-6863-2550"),
        (1, "address", "石桥县东垣区望鹤路101号3单元720室"),
        (1, "id_number", "998120198806095648"),
        (1, "email", "tung-gao @ clinic.example"),
        (4, "phone", "13800138000"),
        (5, "name", "Anna Fairfield"),
        (5, "address", "12 Mill Road, Eastham"),
        (5, "phone", "+1 (555) 555-0123"),
    }
    clean = {r.doc_id: (r.redacted, r.n_found) for r in pii.redact(docs, finder=finder).collect()}
    assert clean[2] == (None, 0) and clean[3] == ("", 0) and clean[1][0].startswith("患者姓名 [NAME]；电话 [PHONE]。另有编号 142-1987。家住[ADDRESS]。")
    assert pii.find_pii(docs.filter("false")).count() == 0


@pytest.mark.parametrize(
    ("before", "address", "after"),
    [
        ("家住", "石家庄市长安区中山东路12号3单元", "，次日复诊。"),
        ("", "黑龙江省哈尔滨市道里区人民中路8号", "。"),
        ("药包送至", "清河镇东街5号", "。"),
        ("服后痛减现寓", "建国门外大街甲6号", "。"),
        ("病家在", "清河镇东街5号", "设铺"),
        ("寄往", "双江拉祜族佤族布朗族傣族自治县勐勐镇南路附12号之3", "。"),
        ("地址:", "沪太路1弄2-3号5楼501室", "。"),
    ],
)
def test_addresses_of_any_length(before, address, after):
    whole = before + address + after
    found = pii.Finder(pii.train([])).spans([whole])[0]
    assert [whole[s.start : s.end] for s, _ in found if s.kind == "address"] == [address]


def test_boosting_learns_and_holds_out():
    rng = np.random.default_rng(10)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.Boosted().fit(x[:1000], y[:1000]).calibrate(x[1000:1500], y[1000:1500])
    assert ((m.predict(x[1500:]) >= m.cutoff) == y[1500:]).mean() > 0.95
    assert boosting.Boosted().fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((1, 2))).shape == (1,)


def test_token_index_loses_no_form_within_the_slips():
    """Every form that edits alone would accept is met by the index, on random words with repeated letters."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("abcde功效证候") for _ in range(rng.randint(1, 14)))
    forms = sorted({word() for _ in range(400)})
    index = canonical.TokenIndex(forms)
    for _ in range(600):
        w = rng.choice(forms) if rng.random() < 0.8 else word()
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice((w[:k] + rng.choice("abx") + w[k:], w[:k] + w[k + 1 :], w[:k] + "y" + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]))
        near = {f for _, f in index.near(w)}
        for f in forms:
            allowed = canonical.slips(max(len(f), len(w)))
            if canonical.tokens(f) & canonical.tokens(w) and canonical.edits(w, f, allowed) <= allowed:
                assert f in near


def test_containers_keep_to_a_topic_from_first_to_last():
    """Share of the commonest topic in containers, early and late: neighbours must not run out while related texts are left."""
    rng = random.Random(28)
    topics = [[chr(0x5000 + 200 * t + i) for i in range(200)] for t in range(6)]
    texts = ["".join(rng.choice(topics[i % 6]) if rng.random() < 0.7 else rng.choice(HAN) for _ in range(rng.randint(20, 120))) for i in range(600)]
    docs, terms, sizes = packing.tokenize(texts)
    held = packing.fill_containers(sizes, 512, packing.Shard(docs, terms, len(texts)), np.arange(len(texts)))
    purity = [max(np.bincount([i % 6 for i in c])) / len(c) for c in held if len(c) > 2]
    k = len(purity) // 3
    assert np.mean(purity[:k]) > 0.95 and np.mean(purity[k : 2 * k]) > 0.95 and np.mean(purity[2 * k :]) > 0.75
    assert np.mean([sizes[c].sum() / 512 for c in held]) > 0.97
