"""Training-data operators: dedup, decontamination, scoring, tokenisation and filtering at corpus scale."""
