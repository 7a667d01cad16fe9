"""Problem 10 on sentences labelled by hand: figures by type.

How far each set was used matters for its figures. Phone cues were added after a first run on GOLD (3 of 5 phones), and
the copies of phones without cues after runs on SEEN (2 of 12 phones before, 12 of 12 after), so that these two are
no longer held out. UNTOUCHED was written before that last change and measured once after it: 5 of 6 phones, and
two numbers of other kinds taken for phones. Nothing was changed after that.

A span counts as found if type and text are exactly right. Names with a cue beside them and names without one are
told apart: the generators propose a Chinese name only beside a cue, so that the figure for uncued ones is low and
is stated as such.
"""

import pytest

from kgloom.llm import pii

#: Sentence and its spans; 'name?' is a name without any cue.
GOLD = (
    ("复诊请拨打13912345678预约。", [("phone", "13912345678")]),
    ("诊所座机：0571-88123456，节假日休息。", [("phone", "0571-88123456")]),
    ("联系手机 +86 186 1234 5678，方账共13片。", [("phone", "+86 186 1234 5678")]),
    ("Please call 415-555-0132 after lunch.", [("phone", "415-555-0132")]),
    ("来电 (021) 5432 1098 转 12 取药。", [("phone", "(021) 5432 1098 转 12")]),
    ("此方出自第1987-2003页，编号 20231104。", []),
    ("药材批号 8801-3345，重 1200 克。", []),
    ("报告请发往 zhou.min_88@hospital.example.cn 收。", [("email", "zhou.min_88@hospital.example.cn")]),
    ("Email: k.larsen (at) clinic (dot) example for copies.", [("email", "k.larsen (at) clinic (dot) example")]),
    ("邮箱lin@herbs.example已失效。", [("email", "lin@herbs.example")]),
    ("原文作“升@斗”，当是误字。", []),
    ("身份证号 320102198503127719 已登记。", [("id_number", "320102198503127719")]),
    ("证件号码：44010619920315003X。", [("id_number", "44010619920315003X")]),
    ("护照号E12345678，有效期至2030年。", [("id_number", "E12345678")]),
    ("Passport no. K0456789 was shown at the desk.", [("id_number", "K0456789")]),
    ("藏书号320102199912317719，共三卷。", []),
    ("家住杭州市西湖区文三路478号华星楼。", [("address", "杭州市西湖区文三路478号")]),
    ("药包寄往成都市武侯区人民南路四段11号2单元301室。", [("address", "成都市武侯区人民南路四段11号2单元301室")]),
    ("地址：青岛市市南区香港中路10号", [("address", "青岛市市南区香港中路10号")]),
    ("病家现住柳溪镇桥头村25号。", [("address", "柳溪镇桥头村25号")]),
    ("Resident at 27 Orchard Lane, Westbury since spring.", [("address", "27 Orchard Lane, Westbury")]),
    ("Parcels went to 8 Station Road, Milton for a year.", [("address", "8 Station Road, Milton")]),
    ("人民路药市每月初一开集，号称百家。", []),
    ("患者姓名：陈建国，男，四十岁。", [("name", "陈建国")]),
    ("联系人：欧阳静怡。", [("name", "欧阳静怡")]),
    ("收件人 黄志强；", [("name", "黄志强")]),
    ("（记录人：何晓芸）", [("name", "何晓芸")]),
    ("其母刘桂兰代述病情。", [("name", "刘桂兰")]),
    ("吴天明先生来诊。", [("name?", "吴天明")]),
    ("昨日赵丽华复诊，舌苔转薄。", [("name?", "赵丽华")]),
    ("孙伟与钱芳同往取药。", [("name?", "孙伟"), ("name?", "钱芳")]),
    ("高建军服药三剂后，汗出热退。", [("name?", "高建军")]),
    ("Patient: Helen Brooks, aged forty.", [("name", "Helen Brooks")]),
    ("The note was signed by Martin Hale.", [("name", "Martin Hale")]),
    ("As Clara Whitcombe recalled, the cough eased.", [("name", "Clara Whitcombe")]),
    ("Yesterday Robert Finch came back for the powder.", [("name?", "Robert Finch")]),
    ("白术、黄芪、金银花各三钱，石膏先煎。", []),
    ("Warm Draught and Golden Powder are older names.", []),
    ("张仲景论曰：太阳病，发热汗出。", []),
)
SEEN = (
    ("取药请先致电药房 13698765432 确认。", [("phone", "13698765432")]),
    ("传真：0755-26781234。", [("phone", "0755-26781234")]),
    ("微信同号15012349876，可留言。", [("phone", "15012349876")]),
    ("Reach the dispensary on +44 20 7946 0958 until five.", [("phone", "+44 20 7946 0958")]),
    ("夜间值班 028-85551234 转 3。", [("phone", "028-85551234 转 3")]),
    ("样本编号13800-2204，共重 1580 克。", []),
    ("稿件请投 editor.fang@press.example。", [("email", "editor.fang@press.example")]),
    ("Questions go to m_ortega [at] lab [dot] example.", [("email", "m_ortega [at] lab [dot] example")]),
    ("登记身份证为510107197211084523。", [("id_number", "510107197211084523")]),
    ("His passport, G61234567, had expired.", [("id_number", "G61234567")]),
    ("寄到南京市鼓楼区汉口路22号。", [("address", "南京市鼓楼区汉口路22号")]),
    ("他搬到白石镇柳巷9号去了。", [("address", "白石镇柳巷9号")]),
    ("She lives at 41 Harbour Street, Linton.", [("address", "41 Harbour Street, Linton")]),
    ("签名：徐慧敏。", [("name", "徐慧敏")]),
    ("患者：司马志远，六十岁。", [("name", "司马志远")]),
    ("经手人 邓文斌；", [("name", "邓文斌")]),
    ("Dear Dr. Irene Calloway, the powder arrived.", [("name", "Irene Calloway")]),
    ("马春燕下午来换药。", [("name?", "马春燕")]),
    ("当归、川芎、白芍各二钱。", []),
    ("南京路旧时多药行。", []),
    ("家人的号码是 17755668899，晚间可打。", [("phone", "17755668899")]),
    ("药铺 0312-5566778 有人值守。", [("phone", "0312-5566778")]),
    ("若发热即拨 13322114455 询问。", [("phone", "13322114455")]),
    ("Ring us at +1 212 555 0147 any weekday.", [("phone", "+1 212 555 0147")]),
    ("The pharmacist answers on +61 2 9876 5432.", [("phone", "+61 2 9876 5432")]),
    ("总机 (0571) 8765 4321，请报姓氏。", [("phone", "(0571) 8765 4321")]),
    ("有事找他 186-5566-7788。", [("phone", "186-5566-7788")]),
    ("批次 20240317，检验号 7781-2290。", []),
    ("卷宗第 13500 号，共 11 册，计 86400 字。", []),
    ("刻本序号 13812345678901，残。", []),
    ("日期 2023-11-05，页 0123-4567。", []),
)
UNTOUCHED = (
    ("侄儿的手头是 15577889900，常在外地。", [("phone", "15577889900")]),
    ("铺面 0451-8877665 已改号。", [("phone", "0451-8877665")]),
    ("夜里可找 199 3344 5566。", [("phone", "199 3344 5566")]),
    ("Leave word at +49 30 901820 before noon.", [("phone", "+49 30 901820")]),
    ("门房 (029) 8123-4567 代收。", [("phone", "(029) 8123-4567")]),
    ("掌柜留下 13144556677 便走了。", [("phone", "13144556677")]),
    ("药价合计 13500 文，另 2788 文未付。", []),
    ("档号 0123-4567890 一册。", []),
    ("库存编号 15812345678，勿动。", []),
    ("全书 186000 字，分 24 卷。", []),
    ("经纬 0571-2024 不可考。", []),
)
LEAST = {"phone": 0.8, "email": 0.9, "id_number": 0.75, "address": 0.6, "name": 0.75}


@pytest.fixture(scope="module")
def found():
    return pii.Finder(pii.train([])).spans([t for t, _ in GOLD])


def figures(found):
    """Type: (spans, of these found, spans said)."""
    out = {k: [0, 0, 0] for k in (*pii.TYPES, "name?")}
    for (text, want), got in zip(GOLD, found, strict=True):
        said = {(s.kind, text[s.start : s.end]) for s, _ in got}
        for kind, span in want:
            out[kind][0] += 1
            out[kind][1] += (kind.rstrip("?"), span) in said
        for kind, _ in said:
            out[kind][2] += 1
    return out


def test_figures_by_type(found):
    got = figures(found)
    print(got)
    for kind, least in LEAST.items():
        assert got[kind][1] >= least * got[kind][0], (kind, got)
    said, right = sum(v[2] for v in got.values()), sum(v[1] for v in got.values())
    assert right >= 0.85 * said, got


def test_sentences_without_personal_information_stay(found):
    assert [(t, [t[s.start : s.end] for s, _ in got]) for (t, want), got in zip(GOLD, found, strict=True) if not want and got] == []


def test_untouched_phones():
    """As measured: 5 of 6 found, 2 wrong. A change that lowers this is a step back; one that raises it by looking at it is no figure."""
    spans = pii.Finder(pii.train([])).spans([t for t, _ in UNTOUCHED])
    said = {(t, t[s.start : s.end]) for (t, _), got in zip(UNTOUCHED, spans, strict=True) for s, _ in got if s.kind == "phone"}
    want = {(t, x) for t, spans in UNTOUCHED for _, x in spans}
    assert len(said & want) >= 5 and len(said - want) <= 2


def test_the_rest_of_a_longer_number_is_no_phone():
    """Met on the larger check table: 122 identity numbers written in groups had come out as phones of their last two groups."""
    texts = [f"其方已验。身份证：{a} 19{y}0621 {b}另有一人同来。" for a, y, b in (("994651", 91, "9147"), ("998219", 74, "4617"), ("990232", 41, "6520"))]
    for text, got in zip(texts, pii.Finder(pii.train([])).spans(texts), strict=True):
        assert [s.kind for s, _ in got if s.kind == "phone"] == [], text
