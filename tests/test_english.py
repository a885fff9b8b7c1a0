from millrace.functions.english import STOP_WORDS, stem

#: Pairs that the algorithm's authors publish.
PUBLISHED = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist,
consistent consist, consistently consist, consisting consist, consists consist, consolation consol, consolations consol, consolatory consolatori,
console consol, consoled consol, consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol,
consolingly consol, consols consol, consonant conson, consort consort, consorted consort, consorting consort, conspicuous conspicu,
conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir, conspiring conspir,
constable constabl, constables constabl, constance constanc, constancy constanc, constant constant,
knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee,
kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif, knife knife,
knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob,
knock knock, knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot"""


def test_published_pairs():
    for pair in PUBLISHED.split(","):
        word, want = pair.split()
        assert stem(word) == want, word


def test_each_step():
    """Rules one by one: plurals, past forms and what they leave, y, and the suffixes by the region they stand in."""
    for word, want in {
        "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "bus": "bus", "dress": "dress", "agreed": "agre", "feed": "feed", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "luxuriated": "luxuri", "hopping": "hop", "hoping": "hope", "hoped": "hope", "cry": "cri", "by": "by", "say": "say", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "operator": "oper",
        "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "sensibility": "sensibl", "triplicate": "triplic", "formative": "format", "electrical": "electr", "goodness": "good", "revival": "reviv", "replacement": "replac",
        "adjustment": "adjust", "adoption": "adopt", "communism": "communism", "probate": "probat", "rate": "rate", "controlling": "control", "roll": "roll", "generate": "generat", "general": "general", "university": "univers", "skies": "sky", "dying": "die",
        "news": "news", "succeed": "succeed", "youth": "youth", "boyish": "boyish", "'tis": "tis", "dog's": "dog", "theology": "theolog", "a": "a", "été": "été",
    }.items():
        assert stem(word) == want, word


def test_stop_words():
    assert len(STOP_WORDS) == 127 and {"the", "now", "i"} <= STOP_WORDS
