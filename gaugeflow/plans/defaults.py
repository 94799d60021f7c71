"""Default column roles, thresholds and estimator settings."""

# The raw column layout of the hourly sensor file.
REQUIRED_COLUMNS = (
    "Date", "Time",
    "CO_GT", "PT08_S1_CO", "C6H6_GT", "PT08_S2_NMHC", "NOx_GT", "PT08_S3_NOx", "NO2_GT",
    "PT08_S4_NO2", "PT08_S5_O3", "Temperature", "Rel_Humidity", "Abs_Humidity",
)
SENSOR_COLUMNS = ("PT08_S1_CO", "PT08_S2_NMHC", "PT08_S3_NOx", "PT08_S4_NO2", "PT08_S5_O3")
GROUND_TRUTH_COLUMNS = ("CO_GT", "NOx_GT", "NO2_GT")
ENVIRONMENT_COLUMNS = ("Temperature", "Rel_Humidity", "Abs_Humidity")
TARGET, FLAG, TIME = "NO2_GT", "High_Pollution", "DateTime"

# Cleaning, features and split.
MISSING_SENTINEL = -200
MAX_MISSING_FRACTION = 0.5
GAP_LIMIT = 5
LAGS = (1, 3, 6)
ROLLING = (3, 6)
REGULATORY_THRESHOLD = 120
TRAIN_RATIO, VAL_RATIO = 0.7, 0.15

# Humidity buckets, season names, decision weights.
HUMIDITY_EDGES = (0, 30, 60, 100)
HUMIDITY_LABELS = ("Low", "Medium", "High")
SEASONS = {
    1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring", 6: "Summer",
    7: "Summer", 8: "Summer", 9: "Autumn", 10: "Autumn", 11: "Autumn", 12: "Winter",
}
TP_BENEFIT, FP_COST, FN_COST, TN_BENEFIT = 10.0, 3.0, 15.0, 0.0
N_THRESHOLDS = 100

# Perceptron profiles.
MLP_PROFILES = {
    "mlp": dict(hidden=(128, 64), activation="relu", rate=0.001, alpha=0.0001, epochs=100, patience=10),
    "mlp_deep": dict(hidden=(256, 128, 64), activation="relu", rate=0.0008, alpha=0.0002, epochs=140, patience=12),
    "mlp_regularized": dict(hidden=(128, 64, 32), activation="tanh", rate=0.0007, alpha=0.001, epochs=120, patience=14),
}
SEED = 42
