"""Marker patterns and phrase lists that results depend on. Patterns hold for any case where they begin with (?i)."""

#: Letters and digits beyond ASCII; markers.py patterns read texts in which each is an underscore, a word character that no class names.
BEYOND_ASCII = r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}\x{FE70}-\x{FEFE}]"

# Discourse moves: a sentence's move is that of its first marker; of markers at one place the first listed counts.
MOVES = {
    "contrast": (r"\b(?:however|but|yet|still|nevertheless|nonetheless)\b", r"\b(?:on the other hand|in contrast|conversely|by contrast|whereas)\b"),
    "concession": (r"\b(?:admittedly|granted|of course|to be sure|certainly|true)\b,", r"\b(?:although|though|while|despite|in spite of|even though|even if)\b"),
    "consequence": (r"\b(?:therefore|thus|hence|consequently|accordingly)\b", r"\b(?:as a result|so that|for that reason|that is why|which is why)\b"),
    "elaboration": (r"\b(?:in other words|that is|namely|specifically|in particular)\b", r"\b(?:more (?:precisely|specifically|formally)|put (?:another|differently))\b"),
    "exemplification": (r"\b(?:for example|for instance|e\.?g\.?|such as|including|like)\b", r"\b(?:consider|take|imagine)\s+(?:the|a|an)\s+\w+"),
    "sequencing": (r"\b(?:first(?:ly)?|second(?:ly)?|third(?:ly)?|finally|lastly)\b,?", r"\b(?:next|then|subsequently|afterwards|meanwhile|in turn)\b"),
    "reframing": (r"\b(?:the (?:better|deeper|real|right) question is)\b", r"\b(?:what matters is|the point is|more (?:importantly|to the point))\b"),
    "epistemic_stance": (r"\b(?:maybe|perhaps|possibly|likely|apparently|presumably|supposedly)\b", r"\b(?:may|might|could)\s+(?:be|have|seem|suggest|indicate)\b", r"\b(?:I\s+(?:think|believe|suspect|guess))\b"),
    "boosting": (r"\b(?:clearly|obviously|definitely|certainly|undeniably|indeed)\b", r"\b(?:of course|without (?:doubt|question)|as everyone knows)\b"),
    "hedging": (r"\b(?:somewhat|sort of|kind of|more or less|to some extent|arguably)\b", r"\b(?:in (?:some|certain) (?:sense|ways|cases)|to a (?:degree|certain extent))\b"),
    "self_correction": (r"\b(?:or rather|or more (?:accurately|precisely)|to put it (?:differently|another way))\b", r"\b(?:not (?:exactly|quite)|better:?\s+|let me rephrase)\b"),
    "metadiscourse": (r"\b(?:as (?:discussed|noted|argued|shown) (?:above|earlier|previously|before))\b", r"\b(?:in this (?:section|chapter|essay|piece)|returning to|coming back to)\b", r"\b(?:as I (?:mentioned|said) (?:above|earlier|before))\b"),
}

# Explicit connectives by the relation that they mostly signal; the longest form at a place counts, once.
RELATION_FORMS = {
    "comparison": ("however", "but", "yet", "although", "though", "whereas", "nevertheless", "nonetheless", "conversely", "similarly", "likewise", "while", "in contrast", "on the other hand", "by comparison", "even though"),
    "contingency": ("because", "therefore", "thus", "hence", "consequently", "if", "unless", "so", "as a result", "so that", "in order to", "for this reason"),
    "expansion": ("and", "also", "furthermore", "moreover", "specifically", "namely", "instead", "rather", "besides", "indeed", "or", "in addition", "for example", "for instance", "in particular", "that is", "in other words"),
    "temporal": ("then", "next", "after", "before", "when", "meanwhile", "subsequently", "finally", "previously", "simultaneously", "until", "once", "since", "as", "as soon as"),
}
AMBIGUOUS_FORMS = ("while", "since", "as", "so", "after", "before", "when", "yet")

# Stock phrases by group.
STOCK_PHRASES = {
    "stock_transitions": ("at the end of the day", "when all is said and done", "needless to say", "it goes without saying", "when it comes to", "in today's world", "more often than not", "the fact of the matter is", "in this day and age", "last but not least", "all things considered"),
    "hedge_boilerplate": ("it's important to note", "it is important to note", "it's worth noting", "it is worth noting", "it should be noted", "one could argue", "it could be argued", "for all intents and purposes"),
    "corporate_cliche": ("think outside the box", "low-hanging fruit", "move the needle", "circle back", "best practices", "game changer", "paradigm shift", "going forward", "touch base", "deep dive"),
    "wordy_filler": ("in order to", "due to the fact that", "a number of", "the vast majority of", "in the event that", "at this point in time", "in spite of the fact that"),
}

# Named craft patterns of a sentence.
CORRECTIO = r"(?i)\b(?:not\s+(?:just|merely|only|simply)?\s*)\S[^.]{2,80}?[,;]\s+but\s+\S"
CORRECTIO_FRAME = r"(?i)\b(?:it|that|this)\s+(?:is|was|will be)\s+not\s+\S"
CORRECTIO_SAME = r"(?i)\b(?:it|that|this)\s+(?:is|was|will be)\s+not\s+\S[^.]{1,100}?[.,;]\s+(?:It|That|This|It's|It is)"
CORRECTIO_NEXT = r"^(?:It|That|This|It's|It is)\s+\S"
APHORISM = r"(?i)\bthere\s+is\s+a\s+kind\s+of\s+\S+\s+in\s+(?:every|all|each)\s+\S|\b(?:is|was)\s+the\s+\S+\s+of\s+\S+(?:\s+\S+){0,3}\s*[.!?]|\b\S+\s+as\s+\S+,\s+(?:the|a)\s+\S+\s+as\s+\S"
FALSE_BALANCE = r"(?i)\bwhile\s+reasonable\s+people\s+(?:may\s+)?disagree|\b(?:there\s+are|we\s+find)\s+valid\s+concerns\s+on\s+both\s+sides|\bsome\s+have\s+argued\s+\S+.{10,150}\s+others\s+have\s+argued|\breasonable\s+(?:people|minds)\s+(?:can|may|might)\s+disagree|\bboth\s+sides\s+(?:have|make|raise)\s+(?:valid|reasonable|legitimate)"
HEDGE_AND_AFFIRM = r"(?i)\bwhile\s+\S[^.]{5,80}?\s+is\s+(?:generally|broadly|largely)\s+true|\balthough\s+\S[^.]{5,100}?,\s+it\s+is\s+also\s+(?:true|important|worth)|\bwhile\s+\S[^.]{5,100}?,\s+(?:in\s+some\s+cases|sometimes|at\s+times)|\b\S[^.]{5,80}?,\s+though\s+of\s+course\s+|\bit\s+is\s+(?:important|worth|essential)\s+to\s+(?:note|consider|recognize)\s+that"
RECOMMENDATION = r"(?i)\b(?:DC|the\s+(?:City|Council|Mayor|Department|Agency|Administration))\s+(?:must|should|needs?\s+to)\s+(?:commit|invest|prioritize|ensure|provide|expand|adopt|develop)|\b(?:we|the\s+\S+)\s+(?:urge|call\s+on|implore|encourage)\s+\S+\s+to|\bit\s+is\s+(?:essential|imperative|critical|necessary|vital)\s+that|\bgoing\s+forward,?\s+\S+\s+should\s+(?:prioritize|ensure|focus|invest)|\b(?:more|greater|additional)\s+(?:investment|funding|attention|focus)\s+(?:is|will\s+be)\s+(?:needed|required|essential)"
AUTHORITY = r"(?i)\b(?:research|studies|evidence|data|literature)\s+(?:has|have)\s+(?:shown|demonstrated|established|consistently\s+shown|repeatedly\s+shown)|\b(?:scholars|researchers|experts|practitioners|economists|sociologists)\s+(?:have\s+)?(?:argued|agree|note|maintain|contend|find)|\bit\s+(?:is|has\s+been)\s+(?:widely|broadly|generally)\s+(?:acknowledged|recognized|accepted|understood)|\bthe\s+(?:research|literature|evidence|data)\s+(?:suggests|indicates|supports|points\s+to)"
TRIPLET = r"(?i)(?:\b\w+(?:\s+\w+){0,2}\b,\s+){2,4}(?:and|or)\s+\b\w+(?:\s+\w+){0,2}\b"

# Constructions of a sentence.
PSEUDO_CLEFT = r"\bWhat\s+[A-Za-z][^.,;]{1,80}?\s+(?:is|are|was|were|matters)\b"
EXISTENTIAL = r"\bThere\s+(?:is|are|was|were|has\s+been|have\s+been|will\s+be|would\s+be|could\s+be|might\s+be|may\s+be)\b"
CORRELATIVES = (
    r"(?i)\bnot\s+only\b[^.]{1,150}?\bbut\s+(?:also|even|rather)?\b",
    r"(?i)\bnot\s+just\b[^.]{1,120}?\bbut\b",
    r"(?i)\beither\b[^.]{1,100}?\bor\b",
    r"(?i)\bneither\b[^.]{1,100}?\bnor\b",
    r"(?i)\bboth\b\s+\S[^.]{1,80}?\band\s+\S",
)
CONCESSIVE_OPENER = r"^\s*(?:Although|Though|Even\s+though|While|Whereas|Despite|In\s+spite\s+of|Notwithstanding)\b"
PARTICIPIAL_OPENER = r"^\s*([A-Z][a-z]+(?:ing|ed))\b[^,.]{0,80},\s"
FRONTED_ADVERBIAL = r"^\s*([A-Z][^,.]{3,80}),\s+[A-Za-z]"
PARENTHETICAL = r"\b\w+(?:\s+\w+){0,3}\s*,\s+([a-z][^,]{4,80}),\s+\w"

# Argument markers.
DISCOUNTING = r"(?i)\b(?:although|though|even\s+though|however|nevertheless|nonetheless|even\s+if|whereas|despite|in\s+spite\s+of|admittedly|granted|but|yet|still|while)\b"
REASON = r"(?i)\b(?:because|since|for|as)\b"
CONCLUSION = r"(?i)\b(?:therefore|hence|thus|so|accordingly|consequently|ergo)\b"
ABUSIVE_ASSURING = r"(?i)\b(?:as\s+everyone\s+knows|of\s+course|obviously|undeniably|without\s+question|no\s+one\s+would\s+deny|it\s+is\s+just\s+common\s+sense|nobody\s+but\s+a\s+fool|everyone\s+with\s+any\s+sense|it\s+goes\s+without\s+saying|needless\s+to\s+say)\b"

# Steps of an argument that state a conclusion, and words that state its warrant.
CONCLUSION_MARKERS = ("therefore", "thus", "hence", "consequently", "so", "it follows", "which shows", "which proves", "clearly", "obviously", "in conclusion", "as a result", "accordingly", "ergo")
WARRANT_MARKERS = ("because", "since", "given that", "the reason is", "the reason being", "on the grounds that", "it follows from", "follows from the fact", "whenever", "in general", "as a rule", "due to", "owing to", "in light of", "by virtue of", "inasmuch as", "insofar as", "for the reason")
STOPWORDS = """
a an the and or but if then so of to in on at by for with as is are was were be been being it its this that these those we you they he she i not no
do does did have has had will would can could should may might must from into than such which who what there their them our us all any more most
some very also
""".split()

# Features of registers, counted per 1000 words.
REGISTER_FEATURES = {
    "heading": r"(?m)^[ \t]{0,3}#{1,6}[ \t]+\S",
    "first_person": r"(?i)\b(?:I|we|my|our|me|us|mine|ours)\b",
    "second_person": r"(?i)\b(?:you|your|yours)\b",
    "question": r"\?",
    "exclamation": r"!",
    "inline_citation": r"\([A-Z][A-Za-z\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z\-]+)?,\s*[0-9]{4}[a-z]?\)|\[[A-Z][A-Za-z\-]+\s+[0-9]{4}[a-z]?\]",
    "statutory": r"\b(?:U\.?S\.?C\.?\s*§|Pub\.\s*L\.|Fed\.\s*R\.|§\s*[0-9]+|[A-Z][A-Za-z\-']+\s+v\.\s+[A-Z][A-Za-z\-']+)",
    "formal_address": r"(?i)\b(?:Mr\.\s+Chairman|Madam\s+Chair|the\s+Committee|Honorable|Senator\s+[A-Z]|Representative\s+[A-Z]|Dear\s+(?:Senator|Mr|Ms|Mrs|Dr)\b)",
    "shall_pursuant": r"(?i)\b(?:shall\s+(?:not\s+)?(?:be|have|apply|provide|include|exclude|govern|prevail|require|prohibit)|pursuant\s+to|notwithstanding\s+the\s+foregoing|hereinafter|hereinbefore|whereas|aforementioned)\b",
    "attributed_quote": r"(?i)\baccording\s+to\b|\b(?:said|told|stated|reported|announced|added|noted)\b\s+(?:[A-Z]|the)",
    "imperative_open": r"(?m)^[ \t]{0,3}(?:Get|Buy|Try|Click|Sign|Subscribe|Discover|Unlock|Transform|Boost|Maximize|Don't\s+miss|Start|Join|Save|Order|Schedule)\b",
    "past_tense_narrative": r"(?i)\b(?:walked|looked|said|knew|thought|wondered|whispered|remembered|noticed|watched|wanted|felt|saw|heard|believed)\b",
    "academic_voice": r"(?i)\b(?:we\s+(?:argue|propose|suggest|claim|show|demonstrate|find|conclude)|this\s+(?:paper|article|study|essay)|in\s+section\s+[0-9]|as\s+(?:argued|noted|shown)\s+(?:above|below|earlier))\b",
}
# Registers: feature, threshold, and whether less is better.
REGISTERS = {
    "formal_legal_policy": (("statutory", 1.5, 0), ("shall_pursuant", 2.0, 0), ("inline_citation", 0.5, 0), ("dialogue_ratio", 0.05, 1), ("first_person", 8.0, 1)),
    "formal_first_person": (("formal_address", 1.0, 0), ("first_person", 8.0, 0), ("statutory", 0.5, 0), ("dialogue_ratio", 0.05, 1)),
    "academic": (("inline_citation", 2.0, 0), ("academic_voice", 1.5, 0), ("dialogue_ratio", 0.03, 1), ("imperative_open", 0.5, 1)),
    "journalism": (("attributed_quote", 2.0, 0), ("dialogue_ratio", 0.10, 0), ("mean_paragraph_words", 80.0, 1), ("first_person", 8.0, 1), ("inline_citation", 1.0, 1)),
    "narrative_fiction": (("dialogue_ratio", 0.15, 0), ("past_tense_narrative", 8.0, 0), ("inline_citation", 0.5, 1), ("statutory", 0.2, 1), ("heading", 0.5, 1)),
    "first_person_essay": (("first_person", 10.0, 0), ("inline_citation", 1.0, 1), ("statutory", 0.3, 1), ("dialogue_ratio", 0.10, 1), ("attributed_quote", 1.0, 1), ("mean_paragraph_words", 30.0, 0)),
    "promotional": (("imperative_open", 1.5, 0), ("exclamation", 5.0, 0), ("second_person", 10.0, 0), ("inline_citation", 0.5, 1)),
    "short_social": (("mean_paragraph_words", 50.0, 1), ("question", 10.0, 0), ("first_person", 10.0, 0), ("inline_citation", 0.5, 1)),
}
