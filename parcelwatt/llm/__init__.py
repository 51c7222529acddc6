"""Training-data operators: filtering, near duplicates, extraction, mixing, packing and search over documents and vectors.

Every operator takes DataFrames and returns a DataFrame. Models are small, are trained here and travel to the tasks as
arguments of bounded size; counts, candidates and scores always cover the whole input.
"""
