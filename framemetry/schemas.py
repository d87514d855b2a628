"""Explicit schemas (Spark DDL); no source is read with inference."""

FRAMES = (
    "frame_id BIGINT, rel_path STRING, grp STRING, h INT, w INT, "
    "bit_depth INT, pixels ARRAY<FLOAT>"
)
REJECTED_FILES = "rel_path STRING, reason STRING"
TILES = "frame_id BIGINT, h INT, w INT, tile INT, top INT, left INT, pixels ARRAY<DOUBLE>"
LABELS = "filename STRING, label INT"
FRAME_METRICS = "rel_path STRING, PSNR DOUBLE, SSIM DOUBLE, EdgeF1 DOUBLE"
EPOCH_LOG = (
    "epoch INT, train_loss DOUBLE, val_loss DOUBLE, val_psnr DOUBLE, val_ssim DOUBLE, "
    "val_edgeF1 DOUBLE, real_psnr DOUBLE, real_ssim DOUBLE, real_edgeF1 DOUBLE, lr DOUBLE, "
    "train_nonfinite INT, val_nonfinite INT, train_batches INT, val_samples INT, grad_norm DOUBLE"
)
SEED_OUTCOMES = (
    "seed INT, model STRING, accuracy DOUBLE, macro_f1 DOUBLE, best_classifier_epoch INT"
)
SEED_SUMMARY = (
    "model STRING, metric STRING, n INT, mean DOUBLE, std_sample DOUBLE, "
    "ci95_low DOUBLE, ci95_high DOUBLE"
)
PAIRED_EFFECTS = (
    "comparison STRING, metric STRING, n INT, mean_delta DOUBLE, sd_delta DOUBLE, "
    "ci95_low DOUBLE, ci95_high DOUBLE, wins INT, ties INT, losses INT, "
    "cohens_dz DOUBLE, exact_sign_flip_p DOUBLE"
)
BOARD_OUTCOMES = "board STRING, material STRING, model STRING, accuracy DOUBLE, macro_f1 DOUBLE"
BOARD_EFFECTS = (
    "board STRING, material STRING, noeca_accuracy DOUBLE, eca_accuracy DOUBLE, "
    "delta_accuracy DOUBLE, noeca_macro_f1 DOUBLE, eca_macro_f1 DOUBLE, delta_macro_f1 DOUBLE"
)
CLASS_F1 = "model STRING, class_id INT, board_balanced_f1_mean DOUBLE"
SIGNAL_AUDIT = (
    "model STRING, output_mean DOUBLE, input_output_correlation DOUBLE, "
    "contrast_retention DOUBLE, gradient_retention DOUBLE, mean_absolute_change DOUBLE, "
    "fraction_at_one DOUBLE"
)
RUN_MANIFEST = (
    "seed INT, model_family STRING, eca_setting STRING, eca_positions STRING, "
    "normalization STRING, supervision STRING, stress_sigma_8bit INT, status STRING"
)
PLOT_ROBUSTNESS = (
    "model_label STRING, metric STRING, mean DOUBLE, std DOUBLE, n_seeds INT, "
    "noise_sigma INT, selection_criterion STRING, plot_order INT"
)
PLOT_DOWNSTREAM = (
    "pipeline_label_full STRING, pipeline_label_short STRING, accuracy_pct DOUBLE, "
    "macro_f1_pct DOUBLE, group_order INT, regime_group STRING"
)
LATENCY = (
    "model STRING, params BIGINT, latency_ms DOUBLE, batch_size INT, "
    "input_resolution STRING, device STRING, notes STRING"
)

# Nested run provenance, in its JSON form.
RUN_PROVENANCE = (
    "run_id STRING, seed INT, "
    "project STRUCT<name: STRING, phase: STRING, canonical: BOOLEAN>, "
    "model STRUCT<family: STRING, variant: STRING, eca_enabled: BOOLEAN, eca_design: STRING, "
    "eca_layers: ARRAY<INT>, depth: INT, features: INT, "
    "normalization: STRUCT<type: STRING, spec: STRING>, residual_learning: BOOLEAN>, "
    "training STRUCT<supervision_regime: STRING, target_type: STRING, "
    "selection_criterion: STRING, freeze_norm_epoch: INT, notes: STRING>, "
    "data STRUCT<task: STRING, split_id: STRING, input_type: STRING, target_type: STRING, "
    "pair_count: BIGINT, preprocessing_id: STRING>, "
    "evaluation STRUCT<downstream_classifier: STRING, metrics: ARRAY<STRING>, "
    "robustness: STRUCT<enabled: BOOLEAN, added_noise_sigma: INT, seeds_evaluated: ARRAY<INT>>>, "
    "artifacts STRUCT<checkpoint_path: STRING, checkpoint_sha256: STRING, "
    "evaluator_script: STRING, evaluator_version: STRING, results_files: ARRAY<STRING>>, "
    "provenance STRUCT<thesis_mapping: STRUCT<chapter: STRING, appendix: STRING>, "
    "status: STRING, comments: STRING>"
)
