"""The physical plan of a DataFrame as text, for tests on plans."""


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
