"""Training-data operators: near-duplicates, tokenizers, archives,
classifiers, URL rules and benchmark decontamination. Nothing else in the
library imports this subpackage."""
