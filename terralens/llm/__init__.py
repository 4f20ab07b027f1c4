"""Training-data operators: near-duplicate removal, decontamination, archives, tokenisation,
secret, personal-data, quality, toxicity and language scans. Nothing outside this folder imports it."""
