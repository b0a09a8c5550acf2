"""The public daily Gulf Coast jet fuel price, first quarter of 2025 (fixed values; None: no price)."""

PRICES = {
    "2025-01-02": 2.266,
    "2025-01-03": 2.272,
    "2025-01-06": 2.283,
    "2025-01-07": 2.293,
    "2025-01-08": 2.286,
    "2025-01-09": None,
    "2025-01-10": 2.406,
    "2025-01-13": 2.385,
    "2025-01-14": 2.365,
    "2025-01-15": 2.463,
    "2025-01-16": 2.43,
    "2025-01-17": 2.419,
    "2025-01-20": None,
    "2025-01-21": 2.411,
    "2025-01-22": 2.369,
    "2025-01-23": 2.362,
    "2025-01-24": 2.384,
    "2025-01-27": 2.324,
    "2025-01-28": 2.31,
    "2025-01-29": 2.317,
    "2025-01-30": 2.285,
    "2025-01-31": 2.302,
    "2025-02-03": 2.358,
    "2025-02-04": 2.301,
    "2025-02-05": 2.271,
    "2025-02-06": 2.294,
    "2025-02-07": 2.301,
    "2025-02-10": 2.293,
    "2025-02-11": 2.357,
    "2025-02-12": 2.277,
    "2025-02-13": 2.27,
    "2025-02-14": 2.276,
    "2025-02-17": None,
    "2025-02-18": 2.262,
    "2025-02-19": 2.33,
    "2025-02-20": 2.358,
    "2025-02-21": 2.266,
    "2025-02-24": 2.209,
    "2025-02-25": 2.163,
    "2025-02-26": 2.119,
    "2025-02-27": 2.166,
    "2025-02-28": 2.145,
    "2025-03-03": 2.088,
    "2025-03-04": 2.076,
    "2025-03-05": 2.089,
    "2025-03-06": 2.063,
    "2025-03-07": 2.071,
    "2025-03-10": 2.006,
    "2025-03-11": 2.039,
    "2025-03-12": 2.04,
    "2025-03-13": 1.999,
    "2025-03-14": 1.997,
    "2025-03-17": 2.035,
    "2025-03-18": 2.03,
    "2025-03-19": 2.066,
    "2025-03-20": 2.084,
    "2025-03-21": 2.082,
    "2025-03-24": 2.091,
    "2025-03-25": 2.121,
    "2025-03-26": 2.124,
    "2025-03-27": 2.111,
    "2025-03-28": 2.093,
    "2025-03-31": 2.135,
}
