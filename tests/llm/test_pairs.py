"""Problem 1 on pairs that did not choose the cutoffs.

REFUSALS met the recall asked for at the first run. The votes on brackets and joining words and the length of stand-ins
were amended after first runs on BROKEN (20 of 23) and SOUND, so that these are no longer held out. UNTOUCHED was
written after the last change and measured once; its figures are asserted as they came, good or not.
"""

from kgloom.llm import pairs

ASKED = "此方由哪些药组成？"
#: Paraphrased refusals, none of them among the pairs that choose the cutoffs.
REFUSALS = (
    "很抱歉，这个问题我没办法回答。",
    "不好意思，这方面的内容我不便评论。",
    "恕我不能提供这类建议，请咨询专业人士。",
    "这超出了我的能力范围，建议您当面问医生，抱歉。",
    "对不起，我无权就此发表意见。",
    "作为人工智能助手，我不能给出用药判断。",
    "此问题不便作答，敬请谅解。",
    "抱歉，本系统暂不提供此类信息。",
    "我不会就这个话题提供任何帮助，请见谅。",
    "遗憾的是，我无法协助您处理这一请求。",
    "出于安全考虑，这个问题恕难回答。",
    "我没有足够的资料来回答，抱歉。",
    "I'm afraid I can't give advice on that.",
    "Sorry, but I am not able to help with this request.",
    "As an AI language model, I cannot provide medical guidance.",
    "I would rather not comment on this, please see a doctor.",
    "Regrettably, this is beyond my ability to answer.",
    "I apologize, but I'm not permitted to discuss this topic.",
    "I must decline to answer that question.",
    "Unfortunately I won't be able to assist with that.",
)
SOUND = (
    "此证不能峻补，先以桂枝9g试之，待3日再议。",
    "前人所述有误，抱歉言之过早：桂枝汤以桂枝9g、芍药9g组成。",
    "桂枝9g、芍药9g、甘草6g，水煎温服",
    "《伤寒论》载桂枝汤，功在解肌发表。",
    "此药虚者不可用，无法久服者改用当归9g。",
    "忌生冷",
    "以桂枝9g配芍药，煎汤分三次饮尽。",
    "Guizhi 9g、芍药9g，分两次服下。",
)
BROKEN = (
    ("empty", ("", "　", "。。。", "无答案", "<br>", "略", "N/A", "待补")),
    ("truncated", ("此方以桂枝9g配芍药，先煎", "组成为桂枝9g、芍药9g，以及", "此方载于《伤寒论", "桂枝9g（去皮", "水煎温服，每服200ml，")),
    ("copied_question", (ASKED, "答：" + ASKED, "问题：" + ASKED + ASKED, "此方由哪些药组成", "此方由哪些药组成。")),
    ("other_language", ("Der Trank wird am Abend warm eingenommen, danach soll man ruhen.", "朝晩に分けて服用し、冷たいものは避けてください。", "따뜻하게 나누어 마시고 찬 음식을 피한다.", "Se toma caliente por la noche y luego se descansa durante tres días.", "Его пьют тёплым вечером, затем отдыхают.")),
)


def found(frame, rows):
    forms = ("此方以桂枝{0}g配芍药，先煎半刻，水煎温服，每服{0}0ml，3日为度。", "芍药{0}g，水煎温服。3日后再服。忌生冷。", "桂枝汤主之，先煎桂枝{0}g，分两次服下，{0}日为度", "Take it warm at dusk, {0} grams, for 3 days.")
    good = [("qa", f"g{i}", f"第{i}条所述之证，{ASKED}" if i % 4 != 3 else f"How should recipe {i} be taken for the cough?", forms[i % 4].format(i)) for i in range(1, 120)]
    df = frame([*good, *rows], "source_table string, record_id string, question string, answer string")
    return {(r.record_id, r.defect) for r in pairs.broken_pairs(df).collect()}


def test_recall_on_paraphrased_refusals(frame):
    got = found(frame, [("qa", f"r{i}", ASKED, a) for i, a in enumerate(REFUSALS)] + [("qa", f"s{i}", ASKED, a) for i, a in enumerate(SOUND)])
    hits = {r for r, d in got if d == "refusal" and r[0] == "r"}
    assert len(hits) >= 0.9 * len(REFUSALS), sorted(set(range(len(REFUSALS))) - {int(r[1:]) for r in hits})
    assert not {(r, d) for r, d in got if r[0] in "sg"}


def test_held_out_pairs_of_the_other_defects(frame):
    rows = [("qa", f"{d}-{i}", ASKED, a) for d, answers in BROKEN for i, a in enumerate(answers)]
    want = {(r[1], r[1].split("-")[0]) for r in rows}
    got = found(frame, rows)
    assert len(got & want) >= 0.9 * len(want), sorted(want - got)
    assert len(got - want) <= 0.05 * len(want), sorted(got - want)


def test_votes_count_more_than_the_trust():
    """A function that is wrong half the time loses its say, whatever it is trusted with at the start."""
    counts = {"++-": 500, "--+": 450, "---": 9000, "-++": 1, "+++": 450}
    post = pairs.label_model(counts, ((10, 10), (10, 10), (50, 50)))
    assert post["++-"] > 0.9 and post["--+"] < 0.5 and post["+++"] > 0.9


def test_end_cells_match_single_ends():
    cells, stops = pairs.end_cells(["桂枝汤 Take it.", "枝。a1"])
    held = dict(zip(cells.tolist(), stops.tolist(), strict=True))
    assert {pairs.cell(x) for x in ("桂", "枝", "汤", "桂枝", "枝汤", "take", "it", "a", "1")} <= set(held)
    assert held[pairs.cell("it")] and not held[pairs.cell("take")] and held[pairs.cell("1")]
    assert pairs.end_cells([])[0].size == 0


UNTOUCHED = {
    "truncated": ["桂枝汤主之，每日服", "以当归12g与川芎", "宜于饭后半个时辰温服，若汗出不", "此方见《金匮要略", "白芍10g、甘草6g；加", "服药期间避风寒并", "Boil it twice and then add", "芍药9g（酒炒"],
    "empty": ["--", "（无内容）", "暂缺", "？", "nil", "<p></p>"],
    "copied_question": ["此方应如何服用", "Q：此方应如何服用？", "您问的是：此方应如何服用？"],
    "other_language": ["On le boit tiède le matin, puis on évite le froid pendant deux jours.", "Bevilo caldo la sera e poi riposa per tre giorni.", "Uống ấm vào buổi tối rồi nghỉ ngơi trong ba ngày.", "温かいうちに飲み、その後は体を冷やさないようにしてください。"],
    "refusal": ["实在抱歉，此事我帮不了您。", "这类用药问题我不能下结论，请您就诊。", "很遗憾，规则不允许我谈这个。", "本助手无从判断，望另询名医。", "I'm sorry, that's not something I can talk about.", "My guidelines prevent me from advising on this.", "No comment.", "对不起，恕我不答。"],
}


def test_untouched_pairs(frame):
    """As measured in a corpus of four sentences: all empty, copied, foreign and refusing answers, but only 4 of 8 truncated ones, and 2 of 4 sound ones are called truncated."""
    ask = "此方应如何服用？"
    sound = ["温服，日二次", "饭后服100ml，忌辛辣。", "每服9g，姜汤送下", "分三次服，3日为度"]
    got = found(frame, [("qa", f"{d}-{i}", ask, a) for d, answers in UNTOUCHED.items() for i, a in enumerate(answers)] + [("qa", f"sound-{i}", ask, a) for i, a in enumerate(sound)])
    hits = {d: sum((f"{d}-{i}", d) in got for i in range(len(answers))) for d, answers in UNTOUCHED.items()}
    assert hits["truncated"] >= 4 and all(hits[d] == len(UNTOUCHED[d]) for d in UNTOUCHED if d != "truncated")
    assert sum(r.startswith("sound") for r, _ in got) <= 2
