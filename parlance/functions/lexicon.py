"""Fixed values that results depend on."""

# French discourse connectors, each counted on its own.
CONNECTORS = [
    "et", "mais", "ou", "donc", "or", "ni", "car",
    "cependant", "pourtant", "néanmoins", "toutefois", "en revanche", "au contraire",
    "parce que", "puisque", "étant donné", "vu que",
    "ainsi", "par conséquent", "de ce fait", "c'est pourquoi",
    "de plus", "en outre", "par ailleurs", "également",
    "bien que", "quoique", "même si", "malgré", "certes",
]

# Subject pronouns.
SUBJECT_PRONOUNS = ["je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles"]

# Characters that form a syllable nucleus.
SYLLABLE_VOWELS = "aeiouyàâéèêëîïôùûü"

# Counted punctuation.
PUNCTUATION = ".,;:!?"

# Thresholds of the upper-case curve, in percent.
THRESHOLD_PERCENTS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]

# Feature groups and their columns.
FEATURE_GROUPS = {
    "punctuation": ["punctuation_punct_ratio"],
    "articles": ["articles_det_ratio"],
    "majuscules": ["majuscules_freq_maj"],
    "prepositions": ["prepositions_freq_prep"],
    "pronouns": ["pronouns_ratio_prodrop"],
    "sentence_structure": [
        "sentence_structure_subj_mean",
        "sentence_structure_verb_mean",
        "sentence_structure_obj_mean",
        "sentence_structure_ratio_sov",
        "sentence_structure_distance_verb_subject",
    ],
    "words_per_sentence": ["words_per_sentence_mean"],
    "discourse_connectors": ["discourse_connectors_freq"],
    "verb_tenses": [
        "verb_tenses_present_ratio",
        "verb_tenses_future_ratio",
        "verb_tenses_past_ratio",
        "verb_tenses_composed_ratio",
    ],
    "readability": ["readability_flesch_fr"],
    "syntactic_complexity": ["syntactic_complexity_dependency_depth"],
    "noun_repetition": ["noun_repetition_ratio"],
    "verb_noun_ratio": ["verb_noun_ratio"],
    "passive": ["passive_ratio"],
}

# Scorer presets.
MODEL_NAMES = {
    "flaubert": "flaubert/flaubert_base_cased",
    "camembert": "camembert-base",
    "roberta": "xlm-roberta-base",
}
MODEL_PRESETS = {
    "flaubert": {"lr": 2e-5, "epochs": 5, "max_length": 256, "batch_size": 8},
    "camembert": {"lr": 3e-5, "epochs": 6, "max_length": 384, "batch_size": 8},
    "roberta": {"lr": 1e-5, "epochs": 6, "max_length": 384, "batch_size": 8},
}
PRESET_FALLBACK = {"lr": 2e-5, "epochs": 3, "max_length": 256, "batch_size": 8}

# Feature-block weights of the one-vs-one classifier.
BLOCK_WEIGHTS = {
    "char_tfidf": 1.0,
    "word_tfidf": 1.0,
    "pos": 0.6,
    "stylometric": 0.3,
    "l1_numeric": 0.8,
    "l1_dep": 1.0,
    "advanced": 0.9,
}

# Strings that a CSV reader of the pandas family takes for null.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
