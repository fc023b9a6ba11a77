"""Analysis plans: one function (Marketplace, Params) -> DataFrame per statement."""
