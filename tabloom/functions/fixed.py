"""Word lists, patterns and step tables.

Fixed values: results depend on them literally, so they are stated as plain text.
"""

# File extensions of images.
IMAGE_PATTERN = r"\.(png|jpg|jpeg|bmp|gif|webp|tif|tiff)$"
IMAGE_FILES = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}"

# Words that decide the class of a log line, in order of precedence.
LINE_CLASSES = {
    "error": ["error", "exception", "traceback", "critical", "failed", "errno"],
    "warning": ["warning", "warn", "deprecated", "no space", "could not"],
    "success": ["success", "complete", "best model", "finished", "saved", "logged"],
    "metric": ["accuracy", "f1", "score", "auc", "rmse", "mse", "r2", "loss"],
    "info": ["info:", "[worker]", "starting", "initialized", "loading", "fitting"],
}

# Block glyphs of progress bars and their plain replacements.
GLYPHS = "█▌▄"
PLAIN = "#|-"

# Metrics looked for on a leaderboard, first present one wins.
METRIC_PRIORITY = ["auc", "logloss", "rmse", "mae", "r2", "mse", "accuracy", "f1"]

# Metrics where a larger value is better; all others are losses.
HIGHER_IS_BETTER = ["auc", "r2", "f1", "accuracy"]

# English function words left out of text features (a parameter of the encoder).
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each either else ever every few for from further "
    "had has have having he her here hers herself him himself his how however i if in into is it its itself just "
    "least less me might more most much must my myself neither no nor not now of off often on once only or other "
    "our ours ourselves out over own per quite rather same she should since so some still such than that the their "
    "theirs them themselves then there these they this those though through thus to too under until up upon us very "
    "was we well were what when where whether which while who whom whose why will with within without would yet you "
    "your yours yourself yourselves"
).split()

# Steps of a training run per engine family: label, words that start it, words that finish it.
RUN_STEPS = {
    "autogluon": [
        ("Data Preparation", ["preprocessing", "converting", "fitting", "loading data", "train_data"],
         ["beginning automl", "fitting model:"]),
        ("Fitting Models", ["fitting model:", "training model for", "fitting with cpus"],
         ["weightedensemble", "autogluon training complete"]),
        ("Stacking / Ensembling", ["weightedensemble", "ensemble weights", "stacking"],
         ["autogluon training complete"]),
        ("Evaluation", ["leaderboard", "best model:", "validation score", "score_val"],
         ["tabularpredictor saved", "best model logged"]),
        ("MLflow Logging", ["mlflow", "log_artifacts", "logged successfully", "artifacts logged"],
         ["thread finished"]),
    ],
    "flaml": [
        ("Data Preparation", ["data ready", "preprocessing", "starting flaml"],
         ["executing hyperparameter search"]),
        ("Hyperparameter Search",
         ["executing hyperparameter search", "automl.fit", "[flaml.automl", "trial", "best config"],
         ["search finished"]),
        ("Best Config Selection", ["search finished", "best estimator", "best loss", "best final"],
         ["saving best model"]),
        ("Model Saving", ["saving best model", "model_path", "artifact_path"],
         ["mlflow", "logged successfully"]),
        ("MLflow Logging", ["mlflow", "log_artifact", "logged successfully"],
         ["thread finished"]),
    ],
    "h2o": [
        ("H2O Cluster Init", ["h2o cluster initialized", "initializing h2o", "h2o init"],
         ["starting h2o automl"]),
        ("Data Preparation", ["preparing data", "h2oframe", "feature engineering", "asfactor"],
         ["starting h2o automl training"]),
        ("AutoML Training", ["starting h2o automl training", "automl session", "training completed", "aml.train"],
         ["training completed in"]),
        ("Leaderboard & Scoring", ["top 5 models", "leaderboard", "best model score", "auc", "total_models_trained"],
         ["model saved at", "log model to mlflow"]),
        ("MLflow Logging", ["mlflow", "log_artifacts", "logged successfully", "artifacts logged"],
         ["thread finished"]),
    ],
    "tpot": [
        ("Data Preparation", ["problem type:", "training data shape", "test data shape", "label encoder"],
         ["starting tpot training"]),
        ("Pipeline Generation (GA)",
         ["starting tpot training", "generation:", "pipeline score:", "optimizing pipeline"],
         ["training completed"]),
        ("Pipeline Selection",
         ["training completed", "best pipeline", "fitted_pipeline_", "accuracy:", "f1_macro:"],
         ["pipeline exported"]),
        ("Export & Analysis", ["pipeline exported", "export", "classification report"],
         ["mlflow"]),
        ("MLflow Logging", ["mlflow", "tpot automl model", "registered_model_name", "logged successfully"],
         ["thread finished"]),
    ],
    "pycaret": [
        ("Environment Setup", ["setting up pycaret", "dataset shape"],
         ["comparing models", "step: comparing models..."]),
        ("Model Comparison", ["comparing models", "including fast/robust models"],
         ["tuning best model", "step: tuning best model..."]),
        ("Hyperparameter Tuning", ["tuning best model", "step: tuning best model..."],
         ["blending top models", "step: blending top models..."]),
        ("Model Blending", ["blending top models", "step: blending top models..."],
         ["saving model", "pycaret experiment completed"]),
        ("MLflow Logging", ["saving model to", "pycaret experiment completed", "thread finished"],
         ["thread finished"]),
    ],
    "lale": [
        ("Pipeline Definition", ["defining lale planned pipeline", "dataset shape"],
         ["tuning with hyperopt", "step: tuning with hyperopt..."]),
        ("Hyperopt Tuning", ["tuning with hyperopt", "step: tuning with hyperopt..."],
         ["fitting lale optimizer", "step: fitting lale optimizer"]),
        ("Fitting Optimizer", ["fitting lale optimizer", "step: fitting lale optimizer"],
         ["saving model locally", "step: saving model locally"]),
        ("Best Model Extraction", ["best pipeline structure:", "best f1 (macro) score"],
         ["saving model locally", "step: saving model locally"]),
        ("MLflow Logging", ["saving model locally", "lale experiment completed", "thread finished"],
         ["thread finished"]),
    ],
}
