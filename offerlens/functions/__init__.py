"""offerlens.functions"""
