"""DataFrame to DataFrame operators.

Most are lazy. Cuts, vocabularies and model counts are staged: a job writes them to the
shared folder once, because they are used several times or because their real size
decides how they are joined.
"""
