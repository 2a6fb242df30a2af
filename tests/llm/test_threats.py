"""Threats and their look-alikes in four languages, and what the path for bare insults is worth."""

import numpy as np

from marquee.llm import toxicity

THREATS = (
    "I am going to kill you|I'm going to kill you|I will kill you|we are gonna shoot him|I want to strangle her|kill yourself|"
    "you should die|go die|drop dead|kys loser|I hope you die|you deserve to die|I'll beat you up|you will burn for this|"
    "I swear I will stab you|wish you were dead|ich werde dich töten|wir werden euch alle umbringen|ich bringe dich um|"
    "ich töte dich|du sollst sterben|stirb endlich|du wirst leiden|ich mache dich kalt|ich möchte ihn erwürgen|"
    "man sollte dich erschießen|je vais te tuer|je veux vous frapper|je te tue|va crever|tu vas mourir|tu devrais crever|"
    "on va les massacrer|crève|je te tuerai|je dois le poignarder lui|voy a matarte|te voy a matar|te mato|te mataré|"
    "vas a morir|ojalá te mueras|muérete|quiero golpearte|vamos a degollar a ellos|mereces morir"
).split("|")
LOOK_ALIKES = (
    "it will kill time|you are a killer player|he will die of cancer|she was killed in a crash|the plan will hurt the economy|"
    "you should dye it red|shoot me an email|I will go to the shop for you|you must see this|he did not kill anyone|"
    "we want to help you|I hope you are well|the frost will kill the plants|you deserve to win|du sollst die Tür öffnen|"
    "ich werde dich besuchen|ich bringe dich zum Bahnhof|ich bringe dir um acht Uhr Tee|er stirbt im Film|"
    "die Firma wird vernichtet|je vais te voir|tu vas partir demain|il est mort hier|elle doit vous parler|"
    "le froid va tuer les plantes|voy a verte mañana|te quiero mucho|vas a ganar|debes comer más|el frío va a matar las plantas|"
    "quiero ayudarte|il a été tué|I'm going to the dead sea with you|do not kill yourself over this|he said you should die"
).split("|")


def kinds(grammar, text):
    return {k for k, x in zip(toxicity.KINDS, grammar.features(text), strict=True) if x}


def test_threats_and_look_alikes():
    g = toxicity.Grammar({}, {}, 0.0, [0.0] * 5).prepared()
    assert sum("threat" in kinds(g, t) for t in THREATS) >= 0.9 * len(THREATS)
    assert sum("threat" in kinds(g, t) for t in LOOK_ALIKES) <= 0.1 * len(LOOK_ALIKES)
    assert kinds(g, "do not kill yourself") == {"negated"} and kinds(g, "they said drop dead") == {"reported"}


def test_wishes_are_read_longest_first():
    g = toxicity.Grammar({"moron": 2.0}, {}, 0.0, [0.0] * 5).prepared()
    symbols = lambda t: [options[0][0] for options in g.rewritten(t.split())]
    assert symbols("you should just die moron") == ["wish", "insult"]
    assert symbols("you should just go") == ["target", "intent", "other", "other"] and symbols("") == []
    assert kinds(g, "drop dead moron") == {"threat", "insult"}  # whoever is wished something is the target
    trie = toxicity.spoken(("a|b c? d",))
    assert sorted(trie) == ["a", "b"] and sorted(trie["a"]) == ["c", "d"] and trie["b"]["c"]["d"] == {None: {}}
    assert toxicity.cues(toxicity.spoken(("go die", "drop dead"))) == {"die", "drop"}


def test_bare_insults_are_needed(spark):
    """Without the path for bare insults, the held-out error of the test tables is at least twice as high."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    g = toxicity.learn(docs, labels.where(~toxicity.held_out())).prepared()
    rows = docs.join(labels, "doc_id").select("text", "toxic", toxicity.held_out().alias("out")).collect()
    x = np.array([g.features(r.text) for r in rows])
    y, out = np.array([float(r.toxic) for r in rows]), np.array([r.out for r in rows])

    def wrong(columns):
        w = toxicity.logistic(x[~out][:, columns], y[~out], np.array(toxicity.PRIOR)[columns])
        return np.mean((np.c_[np.ones(out.sum()), x[out][:, columns]] @ w >= 0) != (y[out] == 1))

    every = list(range(len(toxicity.KINDS)))
    assert 2 * wrong(every) <= wrong(every[:-1])
