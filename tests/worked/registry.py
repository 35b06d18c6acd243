"""Where worked examples are collected: small inputs with known rows, as SQL."""

EXAMPLES, SQL = {}, {}


def query(sql):
    def add(f):
        EXAMPLES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add
