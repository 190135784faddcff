"""Fixed values that must equal the reference application's for equal results.

Everything here is data, stated once, in its natural order.
"""

# --- fixed values: feature order used for segmentation (7) and for the classifiers (+ segment) ---
FEATURES = [
    "recency",
    "frequency",
    "monetary",
    "avg_order_value",
    "purchase_frequency",
    "product_diversity",
    "customer_lifetime_days",
]
CLASSIFIER_FEATURES = FEATURES + ["segment"]

# --- fixed values: segment names handed out by rank (best score first) ---
SEGMENT_NAMES = [
    "Champions",
    "Loyal",
    "Potential",
    "Promising",
    "Customers Needing Attention",
    "At Risk",
    "Hibernating",
    "About to Sleep",
    "New",
    "One-Time Buyers",
]

# --- fixed values: recommendation text per segment name, and the fallback ---
RECOMMENDATIONS = {
    "Champions": "Send exclusive VIP offers and early access to new products",
    "Loyal": "Implement loyalty rewards program with personalized discounts",
    "At Risk": "Send win-back campaigns with special offers",
    "Hibernating": "Re-engagement campaign with strong incentives",
    "New": "Welcome series with product recommendations",
}
DEFAULT_RECOMMENDATION = "Analyze customer behavior for personalized approach"

# --- fixed values: numeric parameters ---
N_CATEGORIES = 6                 # size of the category list product_diversity is divided by
PURCHASE_FREQ_MIN = 0.1          # clip bounds of purchases per 30 days
PURCHASE_FREQ_MAX = 50.0
SCORE_WEIGHTS = (0.4, 0.3, 0.3)  # segment score: (1 - R/maxR), F/maxF, M/maxM
TARGET_WEIGHTS = (0.4, 0.3, 0.3) # purchase label: 1/(R+1), F/maxF, PF/maxPF
TARGET_THRESHOLD = 0.4           # label = 1 when p / max(p) > threshold
DECISION_THRESHOLD = 0.5         # will_purchase when probability > threshold
K_RANGE = (3, 7)                 # inclusive range of k tried for K-Means
KMEANS_STARTS = 10
SEED = 42
TEST_FRACTION = 0.2
CV_FOLDS = 5
LIVE_LOG_CAP = 200
LIVE_DEFAULT_PURCHASE_FREQUENCY = 1.0
LIVE_DEFAULT_PRODUCT_DIVERSITY = 0.5
LIVE_DEFAULT_LIFETIME_DAYS = 30
PROBABILITY_BANDS = [(0.0, 0.3, "0-30%"), (0.3, 0.7, "30-70%"), (0.7, 1.0, "70-100%")]
HISTOGRAM_BINS = 30
AFFINITY_TOP = 20
SEGMENT_MEMBERS_SHOWN = 10

# --- fixed values: classifiers in list order (ties on AUC go to the earlier one) ---
MODEL_NAMES = ["RandomForest", "XGBoost", "LogisticRegression", "GradientBoosting"]
