"""Word lists and thresholds that results depend on."""

FUNCTION_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
could did do does doing down during each few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me might mine more most must my myself no nor not now of off on once one only
or other ought our ours ourselves out over own same shall she should so some such than that the their theirs them
themselves then there these they this those through to too under until up upon us very was we were what when where which
while who whom whose why will with would yet you your yours yourself yourselves
""".split()

CONNECTIVES = [
    "furthermore", "moreover", "additionally", "in addition", "however", "therefore", "thus", "consequently", "hence", "in conclusion",
    "to summarize", "to conclude", "in summary", "it is important to note", "it should be noted", "notably", "interestingly", "importantly",
    "remarkably", "specifically", "particularly", "in particular", "for example", "for instance", "namely", "in other words",
    "that is to say", "as a result", "as such", "indeed", "in fact", "of course", "naturally", "clearly", "obviously", "ultimately",
    "essentially", "fundamentally", "in essence",
]

PRONOUN_SETS = {
    "first_person_singular": "i me my mine myself".split(),
    "first_person_plural": "we us our ours ourselves".split(),
    "second_person": "you your yours yourself yourselves".split(),
    "third_person_singular": "he him his himself she her hers herself it its itself".split(),
    "third_person_plural": "they them their theirs themselves".split(),
    "modal": "can could may might must shall should will would".split(),
    "negation": "no not never none nothing neither nor cannot can't won't shan't isn't aren't wasn't weren't don't doesn't didn't haven't hasn't hadn't wouldn't couldn't shouldn't mightn't mustn't".split(),
    "hedge": "almost apparently arguably basically fairly generally kind likely maybe mostly perhaps possibly probably quite rather relatively seem seemed seeming seems somewhat sort tend tended tends".split(),
}

CONTRACTION = r"\b(?:[a-z]+(?:n't|'re|'ve|'ll|'d|'m)|(?:it|that|there|here|what|who|where|when|why|how|let)'s|(?:he|she|one|everyone|everybody|someone|somebody|anyone|anybody|nobody|nothing)'s|can't|cannot|won't|shan't)\b"

CLUSTERS = {
    "first_person_singular": "i me my mine myself".split(),
    "first_person_plural": "we us our ours ourselves".split(),
    "second_person": "you your yours yourself yourselves".split(),
    "third_person_animate": "he him his himself she her hers herself".split(),
    "third_person_neuter": "it its itself".split(),
    "third_person_plural": "they them their theirs themselves".split(),
    "reflexives": "myself yourself yourselves himself herself itself ourselves themselves".split(),
    "demonstratives": "this that these those".split(),
    "place_deixis": "here there".split(),
    "temporal_deixis": "now then once".split(),
    "modals_epistemic": "could might would".split(),
    "modals_deontic": "must should ought shall".split(),
    "be_forms": "am are be been being is was were".split(),
    "have_forms": "had has have having".split(),
    "do_forms": "did do does doing".split(),
    "negations": "no nor not".split(),
    "articles": "a an the".split(),
    "quantifiers": "all any both each few more most some".split(),
    "intensifiers": "just only so too very".split(),
    "prepositions_spatial": "above below between down in into off on out over through under up upon".split(),
    "prepositions_temporal": "after before during from to until".split(),
    "prepositions_relational": "about against as at by for of with".split(),
    "coordinating_conjunctions": "and but or nor yet".split(),
    "subordinating_conjunctions": "because if when where while until".split(),
    "wh_interrogatives": "how what when where which who whom whose why".split(),
    "comparison": "than such same other".split(),
}

#: signal, direction, threshold, weight, least words, family
THRESHOLDS = [
    ("burstiness_B", "lt", -0.4, 2.0, 200, "syntactic_flattening"),
    ("connective_density", "gt", 20.0, 2.0, 200, "connective_overuse"),
    ("mattr", "lt", 0.65, 1.0, 300, "lexical_compression"),
    ("yules_k", "gt", 200.0, 1.0, 500, "lexical_compression"),
    ("shannon_entropy", "lt", 7.0, 1.0, 2000, "lexical_compression"),
    ("fkgl_sd", "lt", 1.5, 1.5, 200, "syntactic_flattening"),
    ("sentence_length_sd", "lt", 5.0, 0.5, 5000, "syntactic_flattening"),
]

# Phrases that mark a claim as hedged, boosted or stipulated.
CLAIM_HEDGES = (
    "may suggest", "might", "could", "perhaps", "arguably", "seems to", "it seems", "appears to", "it appears", "suggests", "in some cases",
    "to some extent", "somewhat", "possibly", "presumably", "plausibly", "it is possible", "tends to", "on the whole", "more or less",
    "i suspect", "i think", "we think", "probably", "likely",
)
CLAIM_BOOSTERS = (
    "clearly", "obviously", "undeniably", "certainly", "definitely", "without doubt", "without question", "always", "never", "proves",
    "establishes", "demonstrates that", "of course", "indisputably", "unquestionably", "self-evident", "no one can deny", "it is certain",
    "must be", "cannot be denied", "every", "all",
)
CLAIM_STIPULATIONS = (
    "assume", "assuming", "grant that", "granting", "let us grant", "for the sake of argument", "take as given", "taken as given",
    "stipulate", "by stipulation", "suppose that", "posit that",
)
