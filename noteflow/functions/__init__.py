"""noteflow.functions"""
