"""Column functions: cleaning, calendar and labels.

Arguments named by text are SQL expressions, most simply column names. Each function is
one expression inside generated code; none needs Python at run time.
"""
