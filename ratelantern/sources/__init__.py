"""Readers that turn raw documents and tables into DataFrames."""
