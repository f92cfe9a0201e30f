"""Default parameters of the scoring and clustering steps (fixed values)."""

THRESHOLD = 0.40
IF_WEIGHT = 0.60
AE_WEIGHT = 0.40
AE_BENIGN_P95 = 0.50
WINDOW_1M = 60
WINDOW_5M = 300
WINDOW_1H = 3600
CLUSTER_WINDOW = 300
MICROS = 1_000_000
