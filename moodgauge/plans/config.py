"""Job parameters of the registered queries (driver-side settings)."""

# The landed entity -> keywords map ("Nvidia" as stored by the
# surveyed project) plus a second entity whose keywords occur in the test
# prose, so that equal-position and multi-entity cases are exercised.
ENTITY_TERMS = {
    "Nvidia": ["cuda", "graphics", "ai", "raytracing", "gaming"],
    "Intel": ["tion", "ment", "men"],
}
KEYWORD_COUNT = 5          # keywords used per entity
POSTS_PER_ENTITY = 200     # cap of matched posts per entity
PEER_COUNT = 6             # symbols per response

# The inline lexicon of the lexicon-scoring query. Its words
# are frequent tokens of the test prose, so that valence, booster and
# negation rules all fire; valences are ours.
QUERY_LEXICON = {
    "ha": 1.5, "re": -0.8, "er": 0.6, "st": -1.9, "ti": 2.2, "ly": -1.3,
    "nt": 0.9, "ea": -2.4, "ed": 1.1, "ing": 0.4, "tion": -0.5, "ou": 1.7,
}
QUERY_BOOSTERS = {"on": 0.293, "an": -0.293}
QUERY_NEGATIONS = ["not", "no", "never", "nicht", "pas"]

# Words that part a text in the rule-set query: frequent tokens of the test
# prose in its four languages, so that the rule fires.
QUERY_CONTRASTS = ["this", "und", "et", "el"]
