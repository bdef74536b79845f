"""relfeat: relational feature synthesis, sampling, preprocessing and scoring on Spark."""
from .sources.rdb import RelationalDataset, Relationship, TableMeta, create_rdb, load_rdb
from .plans.synthesis import DFSConfig, FeatureDef, SynthesisResult, compute_dfs_features, synthesize
from .operators.prepare import prepare_db

__all__ = ["RelationalDataset", "Relationship", "TableMeta", "create_rdb", "load_rdb", "DFSConfig",
           "FeatureDef", "SynthesisResult", "compute_dfs_features", "synthesize", "prepare_db"]
